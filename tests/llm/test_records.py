import base64
import gzip
import hashlib
import os

import numpy as np
import pytest

from noveltide.llm import chat as C
from noveltide.llm import queries
from noveltide.llm import warc as W

CONV = "conv_id long, turn long, role string, text string, token_ids int"


# --- chat


def digest(rows):
    h, loss = hashlib.sha256(), ""
    for _, _, role, text, _ in rows:
        h.update(f"{role or ''}\n{text or ''}\n".encode())
        loss += (text or "") if role == "assistant" else ""
    return len(rows), h.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "␛", "␛␛</s>", "<|turn|>assistant<|body|>x<|end|>", "␛<s>", "é 漢字 🎉\r\n\t", "", None, "a" * 20_000, " lead", "trail "]
    rows = [(1, k, "user" if k % 2 else "assistant", t, 5) for k, t in enumerate(nasty)]
    rows += [(2, 0, "assistant", "x", None), (2, 0, "assistant", "x", None), (2, 1, "assistant<|body|>", "y", None), (None, 0, "user", "n", 1), (3, None, None, "z", 1), (3, 0, "system", "s", 1)]
    df = spark.createDataFrame(rows, CONV).repartition(5)
    turns = C.format_turns(spark, df)
    got = {r.conv_id: r for r in C.read_back(spark, turns).collect()}
    key = lambda r: tuple((x is not None, x) for x in r[1:4])
    for conv in (1, 2, 3, None):
        want = digest(sorted((r for r in rows if r[0] == conv), key=key))
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == want, conv
    shown = "<s>" + "".join(r.formatted for r in turns.where("conv_id = 2").orderBy("turn", "role", "text").collect()) + "</s>"
    assert got[2].formatted_chars == len(shown) and got[2].text_sha256 == hashlib.sha256(shown.encode()).hexdigest()
    assert C.read_back(spark, C.format_turns(spark, df.limit(0))).count() == 0


def test_escape_is_reversible_and_hides_control_strings():
    for t in ["</s>", "␛</s>", "␛␛", "<s></s>[INST]", "plain", "␛␛␛[/INST]␛"]:
        e = C.escape(t)
        assert C.unescape(e) == t
    assert C.escape("a</s>") == "a␛</s>"


def test_contents_never_hold_reserved_ids_and_mask_is_the_content():
    enc, first = C.encoder(C.ranks()), max(C.ranks().values()) + 2
    assistant = enc.encode_ordinary("assistant")
    ids = np.array(C.assemble(enc, first, "user", "<|end|> q") + C.assemble(enc, first, "assistant", "a</s> b") + C.assemble(enc, first, "assistant", "") + C.assemble(enc, first, "user", "r"))
    assert (ids >= first).sum() == 12
    mask = C.loss_mask(ids, first, assistant)
    assert C.unescape(enc.decode(ids[mask == 1].tolist())) == "a</s> b"


def test_control_conversation_in_the_query(spark):
    r = queries.op5_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    t = "</s>[INST] ok [/INST]"
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, 21, hashlib.sha256(t.encode()).hexdigest())
    assert r.turns_sha256 == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest()


# --- WARC

PAGE = "page_id long, url string, html string, sha string, shard int"


def pages():
    rows = [(k, f"http://x/{k}", f"<p>{k % 40}</p>" * 20, None, 1) for k in range(200)]
    return rows + [(300, None, None, "x", 2), (301, "http://x/ü ö\r\n", "", None, 2), (302, "u", "é漢🎉\r\n\r\nWARC/1.1", None, 2), (5, "http://a", rows[5][2], None, 3), (None, "http://n", rows[7][2], None, 3), (303, "long", "x" * 300_000, None, 3)]


def read(spark, rows, root, **kw):
    df = spark.createDataFrame(rows, PAGE).repartition(4)
    m = W.write(spark, df, root, **kw)
    return m, W.read(spark, root, m, payload=True).collect()


def test_warc_round_trip(spark, tmp_path):
    root = f"file://{tmp_path}/a"
    m, got = read(spark, pages(), root, roll_bytes=4000, shard_rows=50)
    rows = pages()
    assert len(got) == len(rows)
    first = {}
    for p, _, h, *_ in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    html = {(p, h or "") for p, _, h, *_ in rows}
    for r in got:
        if r.record_type == "response":
            assert (r.page_id, r.html) in html and first[r.html] == r.page_id and r.refers_to is None
            assert r.payload_digest == base64.b32encode(hashlib.sha1(r.html.encode()).digest()).decode() and r.payload_bytes == len(r.html.encode())
    by = {base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(): (h, p) for h, p in first.items()}
    for r in got:
        if r.record_type == "revisit":
            h, p = by[r.payload_digest]
            assert r.refers_to == p and r.payload_bytes == len(h.encode()) and r.html is None
    assert sum(r.record_type == "response" for r in got) == len(first)
    assert sum(r.page_id == 5 for r in got) == 2 and sum(r.page_id is None for r in got) == 1
    files = {x.file: x for x in m.collect()}
    assert len(files) > 4 and set(files) == {f for f in os.listdir(tmp_path / "a") if f.endswith(".gz")}
    for f, x in files.items():
        data = (tmp_path / "a" / f).read_bytes()
        assert hashlib.sha256(data).hexdigest() == x.sha256 and len(data) == x.bytes
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: ")
    assert not os.listdir(tmp_path / "a" / "_temporary")


def test_warc_files_are_the_same_on_every_run(spark, tmp_path):
    a, _ = read(spark, pages(), f"file://{tmp_path}/a", shard_rows=50)
    b, _ = read(spark, list(reversed(pages())), f"file://{tmp_path}/b", shard_rows=50)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_warc_least_and_damage(spark, tmp_path):
    m, got = read(spark, pages(), f"file://{tmp_path}/a", least=10**6)
    assert {r.record_type for r in got} == {"response"}
    f = tmp_path / "a" / m.first().file
    good = gzip.decompress(f.read_bytes())
    f.write_bytes(gzip.compress(good.replace(b"<p>", b"<q>", 1)))
    with pytest.raises(Exception, match="digest is wrong|length is wrong"):
        W.read(spark, f"file://{tmp_path}/a", m).count()


def test_warc_of_nothing(spark, tmp_path):
    m, got = read(spark, pages()[:1], f"file://{tmp_path}/a")
    assert len(got) == 1
    df = spark.createDataFrame([], PAGE)
    assert W.read(spark, f"file://{tmp_path}/b", W.write(spark, df, f"file://{tmp_path}/b")).count() == 0
