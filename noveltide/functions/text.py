"""Column functions on text: normalisation, splitting, hashing, sizes and tolerant JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``str`` sees it; Java's ``\s`` and its Unicode mode both differ.
W = r"[\x{0009}-\x{000d}\x{001c}-\x{0020}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: The same class without the blank, and its characters as a string.
NO_BLANK = W.replace(r"\x{001c}-\x{0020}", r"\x{001c}-\x{001f}")
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once: the optimizer copies an expression into every place that names it, but
    not into a lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def normalize_text(text: Column) -> Column:
    """Null is '', ends stripped, lower case, runs of white space one blank."""
    # runs that are one blank already are not matched
    return F.regexp_replace(F.lower(strip(F.coalesce(text, F.lit("")))), f" {W}+|{NO_BLANK}{W}*", " ")


def text_hash(text: Column) -> Column:
    return F.sha2(normalize_text(text), 256)


def bit_length_utf8(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("double") * 8


def clip(text: Column, n: int) -> Column:
    """The first ``n`` characters after stripping."""
    return F.substring(strip(F.coalesce(text, F.lit(""))), 1, n)


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up; 0 for null or empty."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def split_ideas(text: Column) -> Column:
    """Spans of a text: sentences, then clauses at ';' and '—'; the stripped text if nothing is left; [] if empty."""
    # one pass: stripping and dropping what is empty makes cutting at one white space as good as cutting at a run
    pieces = F.split(F.coalesce(text, F.lit("")), f"(?<=[.!?]){W}|[;—]")
    spans = F.filter(F.transform(pieces, strip), lambda s: s != "")
    whole = F.filter(F.array(strip(F.coalesce(text, F.lit("")))), lambda s: s != "")
    return let(spans, lambda s: F.when(F.size(s) > 0, s).otherwise(whole))


def hash_tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, or one stand-in token."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.when(F.size(found) == 0, F.array(F.lit("_empty_"))).otherwise(found)


def hash_bucket(text: Column, buckets: int) -> Column:
    """A stable bucket from the first 32 bits of SHA-256."""
    return (F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def json_object(text: Column) -> Column:
    """The stretch from the first '{' to the last '}', or null."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)(\{.*\})", 1), F.lit(""))


def parse_beliefs(text: Column, labels: list[str]) -> Column:
    """Probabilities for ``labels`` from model output; uniform where nothing usable is found.

    A label may be written with blanks for underscores. Values that are no numbers count 0, negative ones are kept.
    """
    data = F.from_json(json_object(text), "map<string,string>")

    def value(name: str) -> Column:
        spaced = name.replace("_", " ")
        raw = F.when(F.map_contains_key(data, F.lit(name)), F.try_element_at(data, F.lit(name))).otherwise(F.try_element_at(data, F.lit(spaced)))
        return F.coalesce(raw.try_cast("double"), F.lit(0.0))

    raw = F.array(*[value(x) for x in labels])
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    uniform = F.array(*[F.lit(1.0 / len(labels))] * len(labels))
    return F.when(data.isNull() | ~(total > 0), uniform).otherwise(F.transform(raw, lambda x: x / total))


def classify_outcome(text: Column, labels: list[str]) -> Column:
    """0-based label: the JSON field ``label`` if it is one, else the first label the text holds, else the last."""
    names = F.array(*[F.lit(x) for x in labels])
    given = F.trim(F.from_json(json_object(text), "label string")["label"])
    exact = F.array_position(names, F.coalesce(given, F.lit("")))
    held = F.array_position(F.transform(names, lambda x: F.contains(F.coalesce(text, F.lit("")), x)), F.lit(True))
    return F.when(exact > 0, exact - 1).when(held > 0, held - 1).otherwise(F.lit(len(labels) - 1)).cast("int")


def parse_verdict(text: Column) -> Column:
    """Struct of a verifier's answer; whatever cannot be read is not approved."""
    shape = "task_valid string, addresses_critique string, verdict string, unresolved_issues string, reason string"
    data = F.from_json(json_object(text), shape)
    flag = lambda c: F.coalesce(data[c] == "true", F.lit(False))
    # a quoted "true" is text, not a flag
    quoted = lambda c: F.coalesce(F.regexp_like(json_object(text), F.lit(rf'"{c}"\s*:\s*"')), F.lit(False))
    valid, addressed = (flag(c) & ~quoted(c) for c in ("task_valid", "addresses_critique"))
    verdict = F.upper(F.trim(F.coalesce(data["verdict"], F.lit(""))))
    listed = F.from_json(data["unresolved_issues"], "array<string>")
    issues = F.coalesce(listed, F.when(data["unresolved_issues"].isNotNull(), F.array(data["unresolved_issues"])), F.array().cast("array<string>"))
    return F.struct(
        ((verdict == "APPROVE") & valid & addressed).alias("approved"),
        valid.alias("task_valid"),
        addressed.alias("addresses_critique"),
        issues.alias("unresolved_issues"),
        F.trim(F.coalesce(data["reason"], F.lit(""))).alias("reason"),
    )


def parse_judge(text: Column, criteria: list[str]) -> Column:
    """A judge's ratings as a struct of doubles, from the JSON in its answer; null where there is none, or a criterion is
    missing or no number, so that the judge drops out."""
    data = F.from_json(json_object(text), "map<string,string>")
    values = [F.try_element_at(data, F.lit(c)).try_cast("double") for c in criteria]
    whole = values[0].isNotNull()
    for v in values[1:]:
        whole = whole & v.isNotNull()
    return F.when(whole, F.struct(*[v.alias(c) for v, c in zip(values, criteria)]))


def verifier_feedback(verdict: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(verdict["unresolved_issues"], "; "), F.lit("")), verdict["reason"])


def format_usd(x: Column) -> Column:
    return F.when(x.isNull(), "—").when(x < 0.01, F.format_string("$%.6f", x)).otherwise(F.format_string("$%.4f", x))


def safe_name(model: Column) -> Column:
    return F.translate(model, "/:", "__")
