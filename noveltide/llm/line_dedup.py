"""Line dedup: near-equal lines across a corpus are found and all but the first of each group removed.

Main path in DataFrame functions only: character-shingle MinHash signatures, banding, exact Jaccard
verification, then distributed union-find (``common.components``), one line kept per component.

* A line is compared by its *form*: ends trimmed of blanks, lower-cased. Blank lines are never removed.
* Lines of the same form are copies. Other forms are near copies when the Jaccard similarity of their shingle
  sets is ``threshold`` (0.8) or more.
* A document is a (doc_id, text); the kept line of a component is its first in (doc_id, hash of the text, line number)
  order, a null doc_id first.

Shingles are all windows of ``WIDTH`` characters; forms that are shorter have none and are only matched as copies.

Signatures. Every window is hashed once and falls into one of ``PLACES`` places by its hash; a place holds the smallest
value of its windows (one-permutation MinHash). A place without windows borrows from another by fixed steps, and the
number of steps is mixed into what it borrows. Two signatures agree in a place with the probability of their sets'
similarity. ``BANDS`` bands of ``ROWS`` places each, every place in three bands, make a form's buckets; two forms that
share a bucket are candidates. Of pairs of similarity 0.8 about 0.96 share a bucket, of 0.85 0.99, whatever the length
(``tests/llm/test_line_dedup.py`` measures it).

1. Each member of a bucket is compared with two leaders of the bucket (smallest id, and smallest after flipping fixed
   bits of the id), and links are joined to components. This settles large groups of near copies at
   a cost in proportion to their members.
2. What leaders leave apart in a bucket: where at most ``crowd`` members lie outside the bucket's largest component, they
   are compared with all members of other components. Larger buckets are dealt again, by ``FURTHER`` keys of ``DEEPER``
   more places each, and go through steps 1 and 2 as buckets of their own, until none is larger or ``DEPTH`` deals were made;
   then all are compared.

Sieves. A member and its leader are passed over where their signatures agree in fewer than ``AGREE`` places (of pairs of
similarity 0.8 0.005 do), with a form of fewer than ``LONG`` shingles in fewer than ``AGREE_SHORT``, of fewer than
``SHORT`` none. What leaders leave apart is mostly similar by 0.6 to 0.78, which signatures cannot tell from 0.8. So those
members get their set's size and odd sketch: ``WORDS`` x 64 bits, each the parity of the shingles that fall there. A
shingle that only one of two sets holds turns one bit, so sketches differ in no more bits than sets differ in shingles, and
a pair whose sketches differ in more than sets of their sizes may at the threshold is not similar enough. This loses no
link. All pairs that pass are verified, each once.

Nulls and ties: a null text is returned as null; an empty text and blank lines stay. Rows that repeat a doc_id and its
text are one document and get the same result; rows that share only the doc_id are documents of their own. An empty
table gives an empty table. Other columns pass through whatever their names.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, gathered, whole_row

WIDTH, PLACES, ROWS, N_BANDS, BITS = 5, 32, 6, 16, 26
LANES, AGREE, AGREE_SHORT, LONG, SHORT = 7, 20, 12, 64, 16
CROWD, FURTHER, DEEPER, DEPTH = 250, 6, 4, 2
WORDS = 32
#: Links and groups that number so many at most are joined to components in one task.
FEW = 1 << 19
_rnd = random.Random(20_240_601)
TURN = _rnd.getrandbits(62)


def _deal(n: int, rows: int) -> list[list[int]]:
    """``n`` bands of ``rows`` different places, all places in turn."""
    out, pool = [], []
    while len(out) < n:
        if len(pool) < rows:
            more = _rnd.sample(range(PLACES), PLACES)
            pool += [x for x in more if x not in pool] + [x for x in more if x in pool]
        out.append(pool[:rows])
        pool = pool[rows:]
    return out


#: The places of a signature that make a band, and those that deal a crowded bucket again.
BANDS, AGAIN = _deal(N_BANDS, ROWS), [_deal(FURTHER, DEEPER) for _ in range(DEPTH)]


def lines_of(docs: DataFrame) -> DataFrame:
    """(d, k, p, form): every line but empty ones, with its document (doc_id and hash of the text), place and form."""
    lines = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("k"), F.posexplode(F.split(F.lower("text"), "\n")).alias("p", "line"))
    return lines.where("line <> ''").select("d", "k", "p", F.btrim("line", F.lit(" \t\r")).alias("form"))


def shingles(form: str) -> str:
    """SQL for the set of a form's shingles, as 64-bit hashes, from its UTF-16 bytes."""
    return f"array_distinct(transform(sequence(1, length({form}) - {2 * WIDTH - 1}, 2), i -> xxhash64(substring({form}, i, {2 * WIDTH}))))"


def windows(rows: DataFrame, form: str, *keep: str) -> DataFrame:
    """(keep..., x): the 64-bit hash of every shingle of a form, repeats included. One row a shingle stays inside generated code."""
    u = rows.select(*keep, F.encode(form, "UTF-16BE").alias("u"))
    u = u.select(*keep, "u", F.explode(F.expr(f"sequence(1, length(u) - {2 * WIDTH - 1}, 2)")).alias("i"))
    return u.select(*keep, F.expr(f"xxhash64(substring(u, i, {2 * WIDTH}))").alias("x"))


def signatures(forms: DataFrame) -> DataFrame:
    """(a, n, v): one row per distinct form that has shingles, n of them, with the 16-bit values of its places."""
    s = forms.where(F.length("form") >= WIDTH).groupBy(F.xxhash64("form").alias("a")).agg(F.min("form").alias("form"))
    s = s.withColumn("n", F.expr(f"cast(length(encode(form, 'UTF-16BE')) / 2 as int) - {WIDTH - 1}"))
    s = windows(s, "form", "a", "n")  # the exchange by a serves the aggregates that follow
    # the number of windows travels in the key: no window is counted
    s = s.select("a", F.expr(f"cast(n as bigint) * {PLACES // 4} + (x & {PLACES // 4 - 1})").alias("nq"), F.expr("cast(shiftright(x, 5) & 3 as int)").alias("r"), F.expr("cast(shiftrightunsigned(x, 33) as int)").alias("y"))
    s = s.groupBy("a", "nq").agg(*[F.min(F.expr(f"case when r = {i} then y end")).alias(f"y{i}") for i in range(4)])
    s = s.select("a", F.expr(f"nq div {PLACES // 4}").cast("int").alias("n"), F.expr(f"nq % {PLACES // 4}").alias("q"), *[f"y{i}" for i in range(4)])
    s = s.groupBy("a").agg(F.max("n").alias("n"), *[F.min(F.expr(f"case when q = {j // 4} then y{j % 4} end")).alias(f"v{j}") for j in range(PLACES)])
    s = s.select("a", "n", F.array(*[F.expr(f"(v{j} ^ shiftright(v{j}, 15)) & 65535") for j in range(PLACES)]).alias("v"))
    # an empty place j borrows from j + t * (2 j + 1) for the first t that holds a value
    borrowed = f"aggregate(sequence(1, {PLACES - 1}), cast(null as int), (s, t) -> coalesce(s, (v[(j + t * (2 * j + 1)) % {PLACES}] + 2039 * t) & 65535))"
    return s.select("a", "n", F.when(F.expr("exists(v, x -> x is null)"), F.expr(f"transform(v, (x, j) -> coalesce(x, {borrowed}))")).otherwise(F.col("v")).alias("v"))


def keyed(rows: DataFrame, deals: list[list[int]], *parts: str) -> DataFrame:
    """(a, band): a bucket for each deal of places of ``v`` (and of further columns); one row a deal stays inside generated code."""
    rows = rows.select("a", "v", *parts, F.explode(F.sequence(F.lit(0), F.lit(len(deals) - 1))).alias("j"))
    place = [f"v[element_at(array({', '.join(str(d[k]) for d in deals)}), j + 1)]" for k in range(len(deals[0]))]
    return rows.select("a", F.expr(f"xxhash64({', '.join([*parts, 'j', *place])})").alias("band"))


def bands_of(sig: DataFrame) -> DataFrame:
    """(a, band): the buckets of each form."""
    return keyed(sig, BANDS)


def shared(bands: DataFrame) -> DataFrame:
    """(band, a): the members of each bucket of two or more. A hot bucket shrinks in the map side of the aggregate."""
    lead = bands.groupBy("band").agg(F.count("*").alias("c")).where("c > 1").select("band")  # a form is in a bucket once
    maybe = marked(bands.select("a", F.col("band").alias("key")), lead.select(F.col("band").alias("key"))).where("maybe").select("a", F.col("key").alias("band"))
    return maybe.join(lead, "band").select("band", "a")


def sketches(sig: DataFrame) -> DataFrame:
    """(a, n, s0..): seven bits of each place, seven places to a long's lower bytes."""
    parts = [range(k, min(PLACES, k + LANES)) for k in range(0, PLACES, LANES)]
    lanes = [" | ".join(f"shiftleft(cast(v[{j}] & 127 as bigint), {8 * i})" for i, j in enumerate(part)) for part in parts]
    return sig.select("a", "n", *[F.expr(e).alias(f"s{k}") for k, e in enumerate(lanes)])


def agree(l: str, r: str) -> str:
    """SQL for whether two sketches agree in ``AGREE`` places or more; the places of short forms hang together too much to tell."""
    low, high = int("7f" * LANES, 16), int("80" * LANES, 16)
    differ = " + ".join(f"bit_count((({l}.s{k} ^ {r}.s{k}) + {low}L) & {high}L)" for k in range(-(-PLACES // LANES)))
    return f"{differ} <= {PLACES} - case when least({l}.n, {r}.n) >= {LONG} then {AGREE} when least({l}.n, {r}.n) >= {SHORT} then {AGREE_SHORT} else 0 end"


def parities(forms: DataFrame, wanted: DataFrame) -> DataFrame:
    """(a, m, o0..): size and odd sketch of the shingle set of each form (a, form) that is ``wanted`` (a)."""
    s = forms.join(wanted, "a", "left_semi")
    s = s.select("a", F.explode(F.expr(f"transform(array(encode(form, 'UTF-16BE')), u -> {shingles('u')})[0]")).alias("x"))
    s = s.select("a", F.expr(f"cast(shiftrightunsigned(x, 40) & {WORDS - 1} as int)").alias("w"), F.expr("shiftleft(1L, cast(x & 63 as int))").alias("bit"))
    s = s.groupBy("a", F.expr("shiftright(w, 2)").alias("q")).agg(F.count("*").alias("m"), *[F.expr(f"bit_xor(case when (w & 3) = {i} then bit end)").alias(f"o{i}") for i in range(4)])
    return s.groupBy("a").agg(F.sum("m").alias("m"), *[F.expr(f"coalesce(max(case when q = {k // 4} then o{k % 4} end), 0L)").alias(f"o{k}") for k in range(WORDS)])


def may_reach(threshold: float, l: str, r: str) -> str:
    """SQL for whether two odd sketches leave it open that the similarity is ``threshold`` or more."""
    differ = " + ".join(f"bit_count({l}.o{k} ^ {r}.o{k})" for k in range(WORDS))
    # sets of similarity t differ in (1 - t) / (1 + t) of their joint size; the sizes alone may rule it out
    return f"least({l}.m, {r}.m) >= {threshold}D * greatest({l}.m, {r}.m) - 1e-6D and ({differ}) * {1 + threshold}D <= {1 - threshold}D * ({l}.m + {r}.m) + 1e-6D"


def leader_pairs(members: DataFrame, sketch: DataFrame) -> DataFrame:
    """(x, y), x > y: each member of a bucket with its leaders, where their sketches agree."""
    turned = F.col("a").bitwiseXOR(F.lit(TURN))
    lead = members.groupBy("band").agg(F.min("a").alias("l0"), F.min(turned).alias("l1"))
    lead = lead.select("band", F.array_distinct(F.array("l0", F.col("l1").bitwiseXOR(F.lit(TURN)))).alias("l"))
    pairs = members.join(lead, "band").select("a", F.explode("l").alias("l")).where("a <> l")
    pairs = pairs.select(F.greatest("a", "l").alias("x"), F.least("a", "l").alias("y")).distinct()
    both = pairs.join(sketch.alias("l"), F.expr("x = l.a")).join(sketch.alias("r"), F.expr("y = r.a"))
    return both.where(agree("l", "r")).select("x", "y")


def apart(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(band, a, root, most, others): the members of buckets of several components, with the bucket's largest component
    and the number of members outside it."""
    rows = members.join(groups, "a", "left").select("band", "a", F.coalesce("root", "a").alias("root"))
    parts = rows.groupBy("band", "root").agg(F.count("*").alias("n"))
    most = parts.groupBy("band").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n"))
    most = most.where("n > most.n").select("band", F.col("most.root").alias("most"), (F.col("n") - F.col("most.n")).alias("others"))
    return rows.join(most, "band")


def other_pairs(rows: DataFrame, sketch: DataFrame, passes: str) -> DataFrame:
    """(x, y), x > y: pairs in a bucket that are of different components and whose sketches pass."""
    rows = rows.join(sketch, "a")
    few, every = rows.where("root <> most").alias("l"), rows.alias("r")
    on = F.expr(f"l.band = r.band and l.root <> r.root and (l.a < r.a or r.root = r.most) and {passes}")
    return few.join(every, on).select(F.greatest("l.a", "r.a").alias("x"), F.least("l.a", "r.a").alias("y")).distinct()


def dealt_again(rows: DataFrame, sig: DataFrame, deal: int) -> DataFrame:
    """(a, band): smaller buckets for the members of ``rows``, by some more places of their signatures."""
    return keyed(rows.select("band", "a").join(sig, "a"), AGAIN[deal], "band")


def verify(pairs: DataFrame, forms: DataFrame, threshold: float) -> DataFrame:
    """The (x, y) of ``pairs`` whose forms have exact Jaccard similarity >= threshold; forms: (a, form), one row per a."""
    # leaders of many first, so that the texts are compared where the second join deals them, by member
    both = pairs.join(forms.select(F.col("a").alias("y"), F.col("form").alias("fy")), "y").join(forms.select(F.col("a").alias("x"), F.col("form").alias("fx")), "x")
    # texts and sets are bound to variables of lambdas so that each is made once
    sets = f"transform(array(struct(encode(fx, 'UTF-16BE') as x, encode(fy, 'UTF-16BE') as y)), u -> struct({shingles('u.x')} as x, {shingles('u.y')} as y))"
    sizes = f"transform({sets}, t -> struct(size(array_intersect(t.x, t.y)) as k, size(t.x) + size(t.y) as n))"
    return both.where(f"exists({sizes}, r -> r.k >= {threshold}D * (r.n - r.k))").select("x", "y")


def marked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` plus maybe: true for every ``key`` in ``wanted``, and for few others while those fill few of 2^BITS bits.

    A bitmap by hash, of 2^BITS bits at most whatever the input, so it may be broadcast; no row is shuffled to be told
    that it is not wanted.
    """
    at = F.expr(f"key & {(1 << BITS) - 1}")
    bits = wanted.select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit"))
    words = bits.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    hit = F.coalesce(F.expr("getbit(bits, cast(key & 63 as int)) = 1"), F.lit(False))
    return rows.withColumn("word", F.shiftright(at, 6)).join(F.broadcast(words), "word", "left").withColumn("maybe", hit).drop("word", "bits")


def of_members(sig: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """The signatures of members only, which is what the rounds read."""
    sig = scratch.keep(sig.join(members.select("a").distinct(), "a", "left_semi"), "member_signatures")
    scratch.release()
    return sig


def linked(members: DataFrame, sig: DataFrame, check: Callable[[DataFrame], DataFrame], scratch: Scratch, crowd: int = CROWD, known: DataFrame | None = None, sieve: tuple[Callable[[DataFrame], DataFrame], str] | None = None) -> DataFrame:
    """(a, root): the components of the items that have a near copy. ``check`` keeps the pairs (x, y) that are near
    copies; ``known`` are links found elsewhere. ``sieve`` makes finer sketches (a, ...) of the items (a) that leaders leave
    apart, and tells in SQL whether those of l and r pass. ``sig`` has the signatures of members (``of_members``). Shuffles
    are let go after each step, since those of several steps together are larger than any table."""
    sketch = scratch.keep(sketches(sig), "sketches")
    groups = merged(None, known, scratch, "known_groups")
    for deal in range(DEPTH + 1):
        pairs = scratch.keep(leader_pairs(members, sketch), f"pairs{deal}")
        scratch.release()
        groups = merged(groups, scratch.keep(check(pairs), f"edges{deal}"), scratch, f"groups{deal}")
        scratch.release()
        rows = scratch.keep(apart(members, groups), f"apart{deal}")
        scratch.release()
        crowded = F.col("others") > (crowd if deal < DEPTH else 1 << 62)
        few = rows.where(~crowded)
        fine, passes = (scratch.keep(sieve[0](few.select("a").distinct()), f"fine{deal}"), sieve[1]) if sieve else (sketch, agree("l", "r"))
        scratch.release(wait=0.5)
        others = other_pairs(few, fine, passes).join(pairs, ["x", "y"], "left_anti")
        groups = merged(groups, scratch.keep(check(others), f"more{deal}"), scratch, f"all_groups{deal}")
        scratch.release()
        rest = rows.where(crowded)
        if rest.isEmpty():
            break
        again = scratch.keep(dealt_again(rest, sig, deal), f"dealt{deal}")
        members = scratch.keep(shared(again), f"members{deal + 1}")
        if members.isEmpty():
            break
    return groups


def merged(groups: DataFrame | None, edges: DataFrame | None, scratch: Scratch, name: str) -> DataFrame:
    """(a, root) with the components that ``edges`` (x, y) connect made one; only roots take part in the search. Both are files."""
    if groups is None:
        if edges is None:
            return None
        return scratch.keep(components(edges, scratch, few=FEW).select(F.col("id").alias("a"), "root"), name)
    if edges.isEmpty():
        return groups
    edges, now = gathered(FEW, edges, groups)
    new = edges.join(now.select(F.col("a").alias("x"), F.col("root").alias("rx")), "x", "left").join(now.select(F.col("a").alias("y"), F.col("root").alias("ry")), "y", "left")
    new = scratch.keep(new.select(F.coalesce("rx", "x").alias("x"), F.coalesce("ry", "y").alias("y")).where("x <> y").distinct(), f"{name}_new")
    found = scratch.keep(components(new, scratch, few=FEW), f"{name}_found")
    found, now = gathered(FEW, found, groups)
    old = now.join(found.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left").select("a", F.coalesce("top", "root").alias("root"))
    return scratch.keep(old.union(found.select(F.col("id").alias("a"), "root").join(now.select("a"), "a", "left_anti")), name)


def removed_lines(spark: SparkSession, docs: DataFrame, scratch: Scratch, threshold: float = 0.8, crowd: int = CROWD) -> DataFrame:
    """(d, k, gone): for each document that loses lines, the places of those lines."""
    sig = scratch.keep(signatures(lines_of(docs)), "signatures")
    scratch.release(wait=0.5)
    members = scratch.keep(shared(bands_of(sig)), "members")
    scratch.release(wait=0.5)
    sig = of_members(sig, members, scratch)
    scratch.drop("signatures")
    # one pass writes all occurrences, with the form where it is to be verified; the second hash, independent of the
    # first, keeps apart the copies of forms that share the first
    lines = lines_of(docs).where("form <> ''").select("d", "k", "p", F.xxhash64("form").alias("key"), F.xxhash64(F.lit(1), "form").alias("b"), "form")
    lines = marked(lines, members.select(F.col("a").alias("key")).distinct()).withColumnRenamed("key", "a")
    occ = scratch.keep(lines.select("d", "k", "p", "a", "b", F.when(F.col("maybe"), F.col("form")).alias("form")), "lines")
    forms = scratch.keep(occ.where("form is not null").groupBy("a").agg(F.min("form").alias("form")), "forms")
    scratch.release()
    sieve = (lambda wanted: parities(forms, wanted), may_reach(threshold, "l", "r"))
    groups = linked(members, sig, lambda pairs: verify(pairs, forms, threshold), scratch, crowd, sieve=sieve)
    for name in ("member_signatures", "members", "forms"):
        scratch.drop(name)
    scratch.release()
    # only forms that were verified can have a root; the others need no join
    rest = occ.where("form is null").select("d", "k", "p", F.col("a").alias("g"), "b")
    some = occ.where("form is not null").join(groups, "a", "left")
    occ = rest.union(some.select("d", "k", "p", F.coalesce("root", "a").alias("g"), F.when(F.col("root").isNull(), F.col("b")).otherwise(F.lit(0)).alias("b")))
    first = occ.groupBy("g", "b").agg(F.min(F.struct("d", "k", "p")).alias("first"), F.count("*").alias("n")).where("n > 1").select("g", "b", "first")
    gone = occ.join(first, ["g", "b"]).where(~F.struct("d", "k", "p").eqNullSafe(F.col("first")))
    return gone.groupBy("d", "k").agg(F.collect_set("p").alias("gone"))


def dedup_lines(spark: SparkSession, docs: DataFrame, threshold: float = 0.8, prefix: str = "", crowd: int = CROWD) -> DataFrame:
    """``docs`` with near-duplicate lines taken out of ``text``, plus ``{prefix}n_lines`` and ``{prefix}n_removed``."""
    scratch = Scratch(spark, "line-dedup")
    gone = scratch.keep(removed_lines(spark, docs, scratch, threshold, crowd), "removed")
    scratch.keep_only("removed")
    rows = docs.select(whole_row(docs).alias("row"), F.col("doc_id").alias("d"), F.xxhash64("text").alias("k"))
    rows = rows.join(gone.select(F.col("d").alias("gd"), F.col("k").alias("gk"), "gone"), F.expr("d <=> gd and k = gk"), "left")
    kept = F.expr("filter(split(row.text, '\n'), (l, p) -> not array_contains(gone, p))")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    n = F.size(F.split("row.text", "\n")).cast("long")
    n_removed = F.coalesce(F.when(F.col("row.text").isNotNull(), F.size("gone").cast("long")), F.lit(0)).cast("long")
    cols = [(text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns]
    return rows.select(*cols, F.when(F.col("row.text").isNotNull(), n).alias(f"{prefix}n_lines"), n_removed.alias(f"{prefix}n_removed"))
