"""Fuzzy line dedup by MinHash, in DataFrame operations only (operator 9).

1. Lines of equal text collapse to the first in corpus order (document, line number).
2. A line's shingles are all its strings of ``SHINGLE`` characters (UTF-16 units); a shorter line is
   one shingle. Its signature is ``MINIMA`` minima of their hashes. The shingles are rows, a few in
   each, and the minima sums of a group, so that Spark compiles all of it.
3. Banding: every three minima of ``BANDS`` make a key. Of two lines at 80 percent, four in a
   thousand at most share none of the keys. The lines under a key are a list; equal lists count once.
4. In a list one line, its lead, is compared with all others by the exact Jaccard similarity of their
   whole sets of shingles, and distributed union-find joins what is alike. Lists whose lines are then
   in one component are settled. In the others some ``LEADS`` further lines are leads, and at last
   every two lines that have not met and lie in different components meet: no pair is left out.
5. Before that, the lines of long lists (of one template with a variable part, say) are parted anew,
   all together: a line is posted under the rarest of its shingles, one more than may be missing in a
   line alike (prefix filter). Lines alike meet under one of these; template text is too frequent to
   be chosen.
6. From the second leads on, pairs that cannot be alike are told where they meet by bitmaps of their
   shingles: a bit that only one line has stands for a shingle that the other lacks. Such pairs make
   no rows and no comparison of texts, and none is lost.
7. Of each component the first line stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import once
from tallyloom.session import cut, drop

from .components import connected_components

SHINGLE = 9
SKETCH = 14
#: Shingles of a row.
STRIDE = 2
#: Minima of a signature; the hashes are turned to ``TURNS`` positions, as many minima of each.
MINIMA = 16
TURNS = 4
#: The minima of each key; no two keys have two in common.
BANDS = ((0, 3, 4), (1, 6, 7), (5, 8, 11), (2, 12, 13), (9, 14, 15), (10, 11, 12), (5, 6, 14), (1, 2, 9), (8, 10, 15), (4, 7, 13), (0, 6, 12), (2, 3, 8))
#: Leads of the second step of a list.
LEADS = 8
#: 64-bit words of a line's bitmap.
WORDS = 16
#: Lines of a list, open after two steps, from which it is parted by rare shingles.
LONG = 64


def shingles(line: Column, size: int = SHINGLE) -> Column:
    """A hash for each string of ``size`` characters, as often as they occur; of the whole line where it is shorter."""
    at = lambda b: F.sequence(F.lit(1), F.greatest(F.octet_length(b) - (2 * size - 1), F.lit(1)), F.lit(2))
    return once(F.encode(line, "UTF-16BE"), lambda b: F.transform(at(b), lambda i: F.xxhash64(F.substring(b, i, F.lit(2 * size)))))


def sketch(hashes: Column, n: int = SKETCH) -> Column:
    """The n least hashes, each once, in order (a bottom-k sketch; ``line_groups`` takes ``with_minima``)."""
    few = lambda h: F.array_distinct(F.slice(h, 1, 2 * n))
    return once(F.sort_array(hashes), lambda h: F.slice(F.when((F.size(few(h)) < n) & (F.size(h) > 2 * n), F.array_distinct(h)).otherwise(few(h)), 1, n))


def _turned(h: Column, by: int) -> Column:
    return h if by == 0 else F.shiftleft(h, by).bitwiseOR(F.shiftrightunsigned(h, 64 - by))


def _constant(i: int) -> Column:
    """A number for minimum i; those of one turn differ in their two highest bits."""
    c = (i // TURNS << 62) + 0x1234567_89AB_CDE * (i + 1)
    return F.lit(c - 2**64 if c >= 2**63 else c)


def hashed(lines: DataFrame, by: list[str]) -> DataFrame:
    """Rows of ``by``, the number of strings in the line as ``n_grams``, and the hashes ``h0``, ``h1`` of ``STRIDE`` of its shingles.

    A line's last row may hold its last shingle more than once.
    """
    last = F.greatest(F.octet_length("bytes") - (2 * SHINGLE - 1), F.lit(1))
    rows = lines.select(*by, F.encode("line", "UTF-16BE").alias("bytes")).withColumn("last", last)
    rows = rows.select(*by, "bytes", "last", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(2 * STRIDE))).alias("i"))
    at = lambda k: F.col("i") if k == 0 else F.least(F.col("i") + 2 * k, F.col("last"))
    hashes = [F.xxhash64(F.substring(F.col("bytes"), at(k), F.lit(2 * SHINGLE))).alias(f"h{k}") for k in range(STRIDE)]
    return rows.select(*by, ((F.col("last") + 1) / 2).cast("int").alias("n_grams"), *hashes)


def with_minima(lines: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and ``m0``, ``m1``, ... of each group's shingles: minimum i is the least of the turned hashes XOR a constant.

    Two lines have minimum i in common with the probability of their Jaccard similarity.
    """
    rows = hashed(lines, by)
    rows = rows.select(*by, *[_turned(F.col(f"h{k}"), 64 // TURNS * j).alias(f"t{j}_{k}") for j in range(TURNS) for k in range(STRIDE)])
    nearest = lambda i: F.least(*[F.col(f"t{i % TURNS}_{k}").bitwiseXOR(_constant(i)) for k in range(STRIDE)])
    return rows.groupBy(*by).agg(*[F.min(nearest(i)).alias(f"m{i}") for i in range(MINIMA)])


def band_keys() -> Column:
    """A key for each of ``BANDS``."""
    return F.array(*[F.xxhash64(F.lit(n), *[f"m{i}" for i in band]) for n, band in enumerate(BANDS)])


def similar(a: Column, b: Column, percent: int) -> Column:
    """100 * intersection >= percent * union of the shingle sets of two lines."""
    common = lambda x, y: once(F.size(F.array_intersect(x, y)), lambda c: 100 * c >= percent * (F.size(x) + F.size(y) - c))
    return once(F.array_distinct(shingles(a)), lambda x: once(F.array_distinct(shingles(b)), lambda y: common(x, y)))


def _lists(posted: DataFrame) -> DataFrame:
    """``key, id, turn`` of the lists of two or more lines; turn is the step in which a line is a lead of the list, 2 of all others.

    The order of a list's lines is a hash of their ids. Lists of equal lines count once: the first by
    ``often``, where ``posted`` has it, and key. Further columns of ``posted`` stay.
    """
    u = F.shiftrightunsigned(F.xxhash64("id"), 1)
    posted = posted.repartition("key")  # counted and joined by one exchange
    order = F.max("often" if "often" in posted.columns else F.lit(0)).alias("often")
    lists = posted.groupBy("key").agg(order, F.count("*").alias("size"), F.min(u).alias("least"), F.sum(F.shiftright(F.xxhash64("id", F.lit(1)), 20)).alias("who")).where("size > 1")
    lists = lists.groupBy("size", "least", "who").agg(F.min(F.struct("often", "key")).alias("of")).select(F.col("of.key").alias("key"), "size", "least")
    second = (u / F.lit(2.0**63)) * F.col("size") < LEADS
    more = [c for c in posted.columns if c not in ("key", "id", "often")]
    return posted.join(lists, "key").select("key", "id", *more, F.when(u == F.col("least"), 0).when(second, 1).otherwise(2).alias("turn"))


def _part(ids: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """``key, id, n, room, turn`` (always 2) of lists of these lines under the rarest of their shingles among all of them.

    ``n`` is the size of the line's set, ``room`` the number of its shingles that are less rare than the key.
    """
    each = texts.join(ids, "id").select("id", F.array_distinct(shingles(F.col("line"))).alias("grams"))
    each = cut(each.select("id", F.size("grams").alias("n"), F.explode("grams").alias("g")), "grams")
    often = each.groupBy("g").agg(F.count("*").alias("often")).where("often > 1")
    shared = each.join(often, "g").groupBy("id", "n").agg(F.count("*").cast("int").alias("shared"), F.sort_array(F.collect_list(F.struct("often", "g"))).alias("by"))
    # the shingles that no other line has come first in the order of rarity, and are not posted
    first = F.slice("by", F.lit(1), F.greatest(F.size("by") - F.ceil(F.col("n") * percent / 100).cast("int") + 1, F.lit(0)))
    posted = shared.select("id", "n", "shared", F.posexplode(first).alias("nth", "x"))
    posted = cut(posted.select(F.col("x.g").alias("key"), F.col("x.often").alias("often"), "id", "n", (F.col("shared") - 1 - F.col("nth")).alias("room")), "parted")
    out = cut(_lists(posted).withColumn("turn", F.lit(2)), "members")
    drop(each, posted)
    return out


def _bitmaps(texts: DataFrame) -> DataFrame:
    """``id, n_grams``, ``WORDS`` numbers ``w0``, ``w1``, ... in which each shingle of a line sets one bit, and ``n_bits`` that are set."""
    bit = lambda h: F.expr(f"shiftleft(1L, cast(pmod(shiftright({h}, 16), 64) AS INT))")
    rows = hashed(texts, ["id"]).select("id", "n_grams", *[x for k in range(STRIDE) for x in (F.pmod(f"h{k}", F.lit(WORDS)).cast("int").alias(f"at{k}"), bit(f"h{k}").alias(f"bit{k}"))])

    def word(w: int) -> Column:
        each = [F.when(F.col(f"at{k}") == w, F.col(f"bit{k}")).otherwise(F.lit(0).cast("long")) for k in range(STRIDE)]
        return F.bit_or(reduce(lambda x, y: x.bitwiseOR(y), each)).alias(f"w{w}")

    words = rows.groupBy("id", "n_grams").agg(*[word(w) for w in range(WORDS)])
    return words.withColumn("n_bits", reduce(lambda s, t: s + t, [F.bit_count(f"w{w}") for w in range(WORDS)]))


def _may_be_alike(x: str, y: str, percent: int) -> Column:
    """False if the bitmaps of two lines show too many shingles that only one of them has.

    With c bits in common, x has n_bits - c shingles or more of its own, so that c + n_grams - n_bits
    at most are left to share; the similarity of the most that may be shared has to reach ``percent``.
    """
    common = reduce(lambda s, t: s + t, [F.bit_count(F.col(f"{x}.w{w}").bitwiseAND(F.col(f"{y}.w{w}"))) for w in range(WORDS)])
    least = lambda k: percent * (F.col(f"{x}.n_bits") + F.col(f"{y}.n_bits")) - (100 - percent) * (F.col(f"{k}.n_grams") - F.col(f"{k}.n_bits"))
    return (100 + percent) * common >= F.greatest(least(x), least(y))


def line_groups(documents: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, first_doc, first_n`` for each line (n from 0) that repeats an earlier one, and that earlier one.

    Lines are split at \\n and compared without surrounding spaces; blank ones take no part. Equal
    lines are one group; others are linked if the Jaccard similarity of their sets of shingles (see
    above) is at least ``percent`` percent. Rows without id take no part. Rows that repeat an id hold
    the same lines: lines of one id and number stay or go together.
    """
    docs = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).select("doc_id", "n", F.trim("line").alias("line")).where(F.col("line").rlike(r"\S"))
    a, b = F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b")
    each = lines.select(a, b, "doc_id", "n", "line").groupBy("a", "b").agg(F.min(F.struct("doc_id", "n")).alias("node"), F.count("*").alias("copies"), F.first("line").alias("line"))
    classes = with_minima(each.select("a", "b", "node.doc_id", "node.n", "copies", "line"), ["a", "b", "doc_id", "n", "copies"])  # dealt by a, b already
    classes = classes.select("a", "b", F.struct("doc_id", "n").alias("node"), "copies", band_keys().alias("keys"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # the written table fixes the ids

    members = cut(_lists(classes.select(F.explode("keys").alias("key"), "id")), "members")
    wanted = classes.join(members.select("id").distinct(), "id", "left_semi").groupBy("node.doc_id").agg(F.collect_list(F.struct("id", "node.n")).alias("wanted"))
    texts = docs.join(wanted, "doc_id").select(F.split("text", "\n").alias("lines"), "wanted").select("lines", F.explode("wanted").alias("w"))
    texts = cut(texts.select("w.id", F.trim(F.get("lines", F.col("w.n"))).alias("line")).where("line IS NOT NULL").dropDuplicates(["id"]), "texts")
    labels = _settle(members, texts, percent)
    drop(texts)

    # a component is told by its first line; lines of classes that repeat join it, spread over salts, as one component may hold most lines
    salts = 16
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    grouped = classes.select("id", "a", "b", "node", "copies").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    firsts = grouped.where("component IS NOT NULL").groupBy("component").agg(F.min("node").alias("first")).select("component", "first", every_salt)
    alone = grouped.where("component IS NULL AND copies > 1").select("a", "b", F.col("node").alias("first"))
    gone = alone.union(grouped.join(firsts, ["component", "salt"]).where("copies > 1 OR first <> node").select("a", "b", "first"))
    repeats = cut(gone, "gone")
    drop(classes, labels)
    gone = repeats.select("a", "b", "first", every_salt)
    found = lines.select("doc_id", "n", a, b).withColumn("salt", F.pmod(F.xxhash64("doc_id", "n"), F.lit(salts)).cast("int")).join(gone, ["a", "b", "salt"])
    found = cut(found.where(F.struct("doc_id", "n") != F.col("first")).select("doc_id", "n", F.col("first.doc_id").alias("first_doc"), F.col("first.n").alias("first_n")), "found")
    drop(repeats)
    return found


def _settle(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """``node, component`` of the lines that are like others of their lists; ``members`` is used up."""
    labels, bits = _merged(_met(members.withColumn("label", F.col("id")), None, 0, percent), None, texts, percent), None
    for step in (1, 2):
        members = _still_open(members, labels, step)
        if not members.take(1):
            break
        if step == 1:
            bits = cut(_bitmaps(texts.join(members.select("id").distinct(), "id", "left_semi")), "bits")
        elif (long := members.where(F.col("size") > LONG)).take(1):
            old, parted = members, _part(long.select("id").distinct(), texts, percent)
            names = labels.withColumnRenamed("node", "id")
            parted_named = parted.join(names, "id", "left").select("key", "id", "turn", F.coalesce("component", "id").alias("label"), "n", "room")
            members = cut(members.where(F.col("size") <= LONG).select("key", "id", "turn", "label", F.lit(0).alias("n"), F.lit(0).alias("room")).union(parted_named), "members")
            drop(old, parted)
        labels = _merged(_met(members, bits, step, percent), labels, texts, percent)
    drop(members, *([] if bits is None else [bits]))
    return labels


def _met(members: DataFrame, bits: DataFrame | None, step: int, percent: int) -> DataFrame:
    """``src, dst``: the lines of one list and different labels that meet in this step: leads and all others, in step 2 all that are left."""
    columns = ["key", "id", "turn", "label", *(c for c in ("n", "room") if c in members.columns)]
    if bits is not None:
        columns += ["n_grams", "n_bits", *[f"w{w}" for w in range(WORDS)]]
        members = members.join(bits, "id")
    x, y = (members.select(*columns).alias(k) for k in "xy")
    meets = (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label")) & ((F.col("x.turn") > step) | (F.col("x.id") < F.col("y.id")))
    if "room" in columns:
        # where two lines have their rarest common shingle, they have no others in common but less rare ones (positional filter)
        meets = meets & ((100 + percent) * (1 + F.least("x.room", "y.room")) >= percent * (F.col("x.n") + F.col("y.n")))
    if bits is not None:
        meets = meets & _may_be_alike("x", "y", percent)
    met = x.join(y.where(F.col("turn") == step), meets).select(F.greatest("x.id", "y.id").alias("src"), F.least("x.id", "y.id").alias("dst"))
    return cut(met.distinct(), "pairs")


def _merged(pairs: DataFrame, labels: DataFrame | None, texts: DataFrame, percent: int) -> DataFrame:
    """The labels after all pairs that are alike are joined; ``pairs`` and ``labels`` are used up."""
    side = lambda name, line: texts.select(F.col("id").alias(name), F.col("line").alias(line))
    both = pairs.join(side("src", "x"), "src").join(side("dst", "y"), "dst")
    links = cut(both.where(similar(F.col("x"), F.col("y"), percent)).select("src", "dst"), "alike")
    known = links if labels is None else links.union(labels.select(F.col("node").alias("src"), F.col("component").alias("dst")))
    out = connected_components(known)
    drop(pairs, links, *([] if labels is None else [labels]))
    return out


def _still_open(members: DataFrame, labels: DataFrame, step: int) -> DataFrame:
    """``key, id, turn, label, size`` of lists whose lines of this step and later ones lie in several components; ``members`` is used up."""
    left = members.where(F.col("turn") >= step).select("key", "id", "turn").join(labels.withColumnRenamed("node", "id"), "id", "left")
    left = cut(left.select("key", "id", "turn", F.coalesce("component", "id").alias("label")), "left")
    several = left.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count("*").alias("size")).where("l < h").select("key", "size")
    out = cut(left.join(several, "key"), "members")
    drop(members, left)
    return out


def dedup_lines(documents: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (all columns as a struct), ``kept_text``, ``n_lines`` and ``n_removed`` for each document.

    ``kept_text`` is the text without the lines that repeat an earlier line of the corpus; a null text
    stays null and counts 0 lines. Rows without id stay as they are. An empty table gives no rows.
    See ``line_groups``.
    """
    found = line_groups(documents, percent, id_col, text_col)
    dropped = found.groupBy("doc_id").agg(F.collect_set("n").alias("gone"))
    rows = documents.select(F.struct(*[F.col(c) for c in documents.columns]).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.split(F.col(text_col).cast("string"), "\n").alias("lines"))
    rows = rows.join(dropped, "doc_id", "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n"))
    return rows.select("row", kept.alias("kept_text"), F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))
