"""Chat formatting by token-level assembly.

Every segment (role name, content) is encoded on its own with a byte-level vocabulary, and turns are joined by ids
that the vocabulary does not hold: ``TURN`` before the role, ``BODY`` between role and content, ``END`` after the
content, with ``OPEN`` and ``CLOSE`` around the conversation. So no content can form a control id. As text these ids
are the strings in ``CONTROL``; a string of that form inside a role or content is escaped (a U+241B is put in front,
and U+241B itself is doubled), so that the formatted text can be read back as well.

The loss mask covers the content of assistant turns. It is derived by prefix sums over the ids: a place is under the
mask where the number of assistant bodies begun exceeds the number ended.

Turns are ordered by (turn, role, text), nulls first; repeated rows are turns of their own. A null text or role is
empty; a null conv_id is one conversation. A conversation is one row per turn, not one row, so that one of any
length needs bounded memory: its turns are formatted on all executors, and its digest, a chain over its whole text
by definition, is taken from a sorted stream in constant memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The written form of the reserved ids, in the order of the ids, which follow the vocabulary's last.
CONTROL = ("<s>", "</s>", "<|turn|>", "<|body|>", "<|end|>", "[INST]", "[/INST]")
OPEN, CLOSE, TURN, BODY, END = range(5)
ESCAPE = "␛"
NEEDS = re.compile("|".join(map(re.escape, (ESCAPE, *CONTROL))))
BACK = re.compile(ESCAPE + "(" + "|".join(map(re.escape, (ESCAPE, *CONTROL))) + ")")
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def escape(text: str) -> str:
    return NEEDS.sub(lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return BACK.sub(lambda m: m[1], text)


def ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoder(table: dict[bytes, int]):
    """One encoder a Python worker."""
    store = sys.__dict__.setdefault("_noveltide_encoders", {})
    key = (len(table), max(table.values()))
    if key not in store:
        import tiktoken

        store[key] = tiktoken.Encoding("chat", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})
    return store[key]


def assemble(enc, first: int, role: str, text: str) -> list[int]:
    """Ids of one turn; ``first`` is the id of ``OPEN``."""
    return [first + TURN, *enc.encode_ordinary(escape(role)), first + BODY, *enc.encode_ordinary(escape(text)), first + END]


def loss_mask(ids: np.ndarray, first: int, assistant: list[int]) -> np.ndarray:
    """1 for the ids of assistant contents, by prefix sums; ``assistant`` is the encoded role name."""
    n = len(assistant)
    head = np.concatenate(([first + TURN], assistant, [first + BODY]))
    begun = np.zeros(len(ids) + 1, np.int64)
    if len(ids) >= n + 2:
        at = np.nonzero((np.lib.stride_tricks.sliding_window_view(ids, n + 2) == head).all(1))[0] + n + 2
        begun[at] = 1
    open_ = np.cumsum(begun[:-1])
    # an end counts where its turn is an assistant's: where a body has begun since the turn's start
    turn = np.cumsum(ids == first + TURN)
    own = np.bincount(turn, begun[:-1], minlength=int(turn.max(initial=0)) + 1)[turn] > 0
    return (open_ - np.cumsum((ids == first + END) & own)).astype(np.int8)


def read_turn(enc, first: int, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str]:
    """(role, content, text under the mask), unescaped, of one turn's ids."""
    body = int(np.nonzero(ids == first + BODY)[0][0])
    role = enc.decode(ids[1:body].tolist())
    text = enc.decode(ids[body + 1 : -1].tolist())
    return unescape(role), unescape(text), unescape(enc.decode(ids[mask == 1].tolist())) if mask.any() else ""


def written(enc, first: int, ids: np.ndarray) -> str:
    """The formatted text of ids."""
    out, start = [], 0
    for k in np.nonzero(ids >= first)[0].tolist():
        out += [enc.decode(ids[start:k].tolist()), CONTROL[ids[k] - first]]
        start = k + 1
    return "".join(out) + enc.decode(ids[start:].tolist())


def format_turns(spark: SparkSession, rows: DataFrame, path: str = VOCABULARY, formatted: bool = True) -> DataFrame:
    """conv_id, turn, role, text, token_ids, loss_mask, formatted: one row per turn, without ``OPEN`` and ``CLOSE``.
    ``formatted=False`` leaves the text of the ids null, for readers of the ids."""
    table = ranks(path)
    shared, first = spark.sparkContext.broadcast(table), max(table.values()) + 2  # of fixed size: the vocabulary

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(shared.value)
        assistant = enc.encode_ordinary("assistant")
        for x in batches:
            ids = [np.array(assemble(enc, first, r or "", t or ""), np.int64) for r, t in zip(x["role"], x["text"])]
            masks = [loss_mask(i, first, assistant) for i in ids]
            x = x.astype({"conv_id": "Int64", "turn": "Int64"})
            yield x.assign(token_ids=[i.astype(np.int32) for i in ids], loss_mask=masks, formatted=[written(enc, first, i) if formatted else None for i in ids])

    cols = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return cols.mapInPandas(run, "conv_id long, turn long, role string, text string, token_ids array<int>, loss_mask array<byte>, formatted string")


def read_back(spark: SparkSession, turns: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row per conversation, read from token_ids and loss_mask alone: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, n_tokens, loss_tokens, text_sha256 (of the formatted text)."""
    table = ranks(path)
    shared, first = spark.sparkContext.broadcast(table), max(table.values()) + 2
    frame = len(CONTROL[OPEN]) + len(CONTROL[CLOSE])
    kind = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long, text_sha256 string"
    names = [c.split()[0] for c in kind.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(shared.value)
        now, state = None, None

        def done():
            return (None if now == "null" else now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4] + frame, state[5] + 2, state[6], (state[7].update(CONTROL[CLOSE].encode()), state[7].hexdigest())[1])

        for x in batches:
            out = []
            for conv, ids, mask in zip(x["conv_id"], x["token_ids"], x["loss_mask"]):
                conv = "null" if pd.isna(conv) else int(conv)
                if conv != now:
                    if state:
                        out.append(done())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0, hashlib.sha256(CONTROL[OPEN].encode())]
                ids, mask = np.asarray(ids, np.int64), np.asarray(mask, np.int8)
                role, text, under = read_turn(enc, first, ids, mask)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state[2] += len(under)
                state[3].update(under.encode("utf-8", "surrogatepass"))
                shown = written(enc, first, ids)
                state[4] += len(shown)
                state[5] += len(ids)
                state[6] += int(mask.sum())
                state[7].update(shown.encode("utf-8", "surrogatepass"))
            if out:
                yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
        if state:
            yield pd.DataFrame([done()], columns=names).astype({"conv_id": "Int64"})

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "token_ids", "loss_mask").mapInPandas(run, kind)


def control_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts hold control strings."""
    text = "</s>[INST] ok [/INST]"
    rows = [Row(conv_id=-7, turn=0, role="user", text=text), Row(conv_id=-7, turn=1, role="assistant", text=text)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
