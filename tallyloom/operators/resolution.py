"""Matching documents to clients, finding duplicates, and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import constants as K
from tallyloom.functions import text as T
from tallyloom.session import cut

#: Characters of a name that make a key of the substring rule.
GRAM = 5
_FIELDS = [("pan", 95), ("gstin", 90), ("tan", 88), ("aadhaar", 82)]


def match_in_firm(docs: DataFrame, clients: DataFrame) -> DataFrame:
    """For each document (id, firm_id, document_type, pan, gstin, aadhaar, name): its client within the firm.

    Rules in order: PAN 1.0; PAN inside the GSTIN 0.98; Aadhaar 0.95, and where several clients share it
    0.92 for the personal primary one of identity documents, else ambiguous 0.50; name (either contains
    the other) 0.75, or ambiguous 0.40. Each rule is an equi-join; the last only meets documents that no
    other rule took.
    """
    c = clients.where("is_active").select(F.col("firm_id").alias("_firm"), F.col("id").alias("client_id"), F.upper("pan_number").alias("_pan"), F.regexp_replace("aadhaar_number", r"[\s-]", "").alias("_aad"), F.lower(F.trim("client_name")).alias("_name"), ((F.col("client_type") == "personal") & F.col("is_primary_personal")).alias("_prime"))
    d = docs.select("id", F.col("firm_id").alias("_firm"), F.lower(F.coalesce("document_type", F.lit(""))).alias("_type"), T.normalize_pan(F.col("pan")).alias("_pan"), T.pan_from_gstin(F.col("gstin")).alias("_gst"), T.digits(F.col("aadhaar")).alias("_aad"), F.lower(F.trim("name")).alias("_name"))

    def found(rule: int, confidence: Column, ambiguous: Column, reason: str, client: Column) -> list[Column]:
        return [F.lit(rule).alias("rule"), client.alias("client_id"), confidence.alias("confidence"), ambiguous.alias("ambiguous"), F.lit(reason).alias("reason")]

    by = lambda key, other: d.where(F.coalesce(F.col(key), F.lit("")) != "").select("id", "_firm", "_type", F.col(key).alias(other)).join(c, ["_firm", other])
    one = by("_pan", "_pan").groupBy("id").agg(F.min("client_id").alias("c")).select("id", *found(1, F.lit(1.0), F.lit(False), "PAN match", F.col("c")))
    two = by("_gst", "_pan").groupBy("id").agg(F.min("client_id").alias("c")).select("id", *found(2, F.lit(0.98), F.lit(False), "PAN in GSTIN", F.col("c")))
    a = by("_aad", "_aad").groupBy("id").agg(F.count("*").alias("n"), F.min("client_id").alias("c"), F.min(F.when(F.col("_prime"), F.col("client_id"))).alias("p"), F.first("_type").alias("t"))
    prime = F.col("p").isNotNull() & T.contains_any(F.col("t"), ["aadhaar", "passport", "driving license"])
    many = F.col("n") > 1
    three = a.select("id", *found(3, F.when(~many, 0.95).when(prime, 0.92).otherwise(0.5), many & ~prime, "Aadhaar match", F.when(~many, F.col("c")).when(prime, F.col("p"))))
    taken = one.union(two).union(three)
    rest = d.where(F.coalesce(F.col("_name"), F.lit("")) != "").join(taken.select("id"), "id", "left_anti")
    x = cut(rest.select("id", "_firm", F.col("_name").alias("_own")), "names")  # both ways of the name rule read it several times
    y = c.select("_firm", "client_id", "_name").where(F.coalesce(F.col("_name"), F.lit("")) != "")
    n = _either_contains(x, y).groupBy("id").agg(F.count("*").alias("n"), F.min("client_id").alias("c"))
    four = n.select("id", *found(4, F.when(F.col("n") > 1, 0.4).otherwise(0.75), F.col("n") > 1, "Name match", F.when(F.col("n") == 1, F.col("c"))))
    best = taken.union(four).groupBy("id").agg(F.min_by(F.struct("client_id", "confidence", "ambiguous", "reason"), "rule").alias("m"))
    return docs.select("id").join(best, "id", "left").select("id", "m.client_id", F.coalesce("m.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("m.ambiguous", F.lit(False)).alias("ambiguous"), F.col("m.reason").alias("reason"))


def _parts(name: Column, n: Column) -> Column:
    """The substrings of n characters."""
    return F.when(F.length(name) >= n, F.transform(F.sequence(F.lit(1), F.length(name) - n + 1), lambda i: F.substring(name, i, n))).otherwise(F.array().cast("array<string>"))


def _contained(short: DataFrame, long: DataFrame) -> DataFrame:
    """Pairs (``short_id``, ``long_id``) of a firm where the long side's name contains the short side's; both are (id, _firm, name).

    A name that another contains has all its substrings in it. The long side posts its substrings of
    ``GRAM`` characters, and of the lengths under that which the firm's short names have. The short side
    looks only under the substring that fewest of its firm's long names hold, so a syllable that most
    names share brings no pairs, and not at all if none holds one of them. What meets is confirmed.
    """
    lengths = short.where(F.length("name") < GRAM).groupBy("_firm").agg(F.collect_set(F.length("name")).alias("sizes"))
    sizes = F.concat(F.array(F.lit(GRAM)), F.coalesce("sizes", F.array().cast("array<int>")))
    every = F.array_distinct(F.flatten(F.transform(sizes, lambda n: _parts(F.col("name"), n))))
    posted = long.join(lengths, "_firm", "left").select(F.col("id").alias("long_id"), "_firm", F.col("name").alias("long_name"), F.explode(every).alias("_k"))
    often = posted.groupBy("_firm", "_k").agg(F.count("*").alias("n"))
    own = F.when(F.length("name") < GRAM, F.array("name")).otherwise(F.array_distinct(_parts(F.col("name"), F.lit(GRAM))))
    asked = short.select(F.col("id").alias("short_id"), "_firm", F.col("name").alias("short_name"), F.size(own).alias("_all"), F.explode(own).alias("_k"))
    rarest = asked.join(often, ["_firm", "_k"]).groupBy("short_id", "_firm", "short_name").agg(F.min_by("_k", F.struct("n", "_k")).alias("_k"), (F.count("*") == F.first("_all")).alias("_held"))
    met = rarest.where("_held").join(posted, ["_firm", "_k"])
    return met.where(F.col("long_name").contains(F.col("short_name"))).select("short_id", "long_id")


def _either_contains(x: DataFrame, y: DataFrame) -> DataFrame:
    """Pairs of a firm (id, client_id) whose names ``_own`` and ``_name`` contain one another, each once."""
    a = x.select("id", "_firm", F.col("_own").alias("name")).where("name <> ''")
    b = y.select(F.col("client_id").alias("id"), "_firm", F.col("_name").alias("name")).where("name <> ''")
    inside = _contained(a, b).select(F.col("short_id").alias("id"), F.col("long_id").alias("client_id"))
    around = _contained(b, a).select(F.col("long_id").alias("id"), F.col("short_id").alias("client_id"))
    return inside.union(around).distinct()


def match_in_registry(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """For each document (id, pan, gstin, tan, aadhaar, aadhaar_confidence) the first registry row (registry_idx) that any identifier hits.

    Both sides become rows of kind and value, so that one equi-join does what an OR of equalities would
    do by a Cartesian product; within a row PAN goes before GSTIN, TAN and Aadhaar.
    """
    norm = {"pan": F.upper("pan"), "gstin": F.upper("gstin"), "tan": F.upper("tan"), "aadhaar": F.regexp_replace("aadhaar", r"\D", "")}

    def long(df: DataFrame, extra: list[str], gate: dict[str, Column]) -> DataFrame:
        items = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(p).alias("points"), F.when(gate.get(k, F.lit(True)), norm[k]).alias("value")) for i, (k, p) in enumerate(_FIELDS)])
        return df.select(*extra, F.explode(items).alias("k")).select(*extra, "k.*").where("value IS NOT NULL AND value <> ''")

    d = long(docs, ["id"], {"aadhaar": F.col("aadhaar_confidence") >= 75})
    r = long(registry, ["registry_idx", "client_id"], {}).drop("points")
    hits = d.join(r, ["rank", "value"])
    best = hits.groupBy("id").agg(F.min_by(F.struct("client_id", "points", "rank"), F.struct("registry_idx", "rank")).alias("m"))
    fields = F.array(*[F.lit(k) for k, _ in _FIELDS])
    return docs.select("id").join(best, "id", "left").select("id", F.col("m.client_id").alias("client_id"), F.coalesce("m.points", F.lit(0)).alias("match_confidence"), F.get(fields, F.col("m.rank")).alias("match_field"))


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def fingerprint(document_type: Column, pan: Column, aadhaar: Column, gstin: Column, tan: Column, year: Column) -> Column:
    """md5 of type and identifiers; documents of one type without identifiers share it."""
    none = lambda c: F.coalesce(c, F.lit(""))
    return F.md5(F.upper(F.concat_ws("|", none(document_type), none(pan), F.regexp_replace(none(aadhaar), r"\D", ""), none(gstin), none(tan), none(year))))


def find_duplicates(files: DataFrame) -> DataFrame:
    """Files (seq, file, sha, fp) in arrival order with ``duplicate_type`` (exact, semantic or null) and ``original_file``.

    A file of a hash seen before is exact and its fingerprint is not registered. A null hash is never exact.
    First files come from aggregates, so that a hash or fingerprint of very many files needs no window.
    """
    first_sha = files.where("sha IS NOT NULL").groupBy("sha").agg(F.min_by("file", "seq").alias("_f"), F.min("seq").alias("_s"))
    a = files.join(first_sha, "sha", "left").withColumn("_exact", F.coalesce(F.col("seq") > F.col("_s"), F.lit(False)))
    first_fp = a.where("NOT _exact").groupBy("fp").agg(F.min_by("file", "seq").alias("_g"), F.min("seq").alias("_t"))
    b = a.join(first_fp, "fp", "left").withColumn("_sem", ~F.col("_exact") & F.coalesce(F.col("seq") > F.col("_t"), F.lit(False)))
    kind = F.when(F.col("_exact"), "exact").when(F.col("_sem"), "semantic")
    return b.select("seq", "file", "sha", "fp", kind.alias("duplicate_type"), F.when(F.col("_exact"), F.col("_f")).when(F.col("_sem"), F.col("_g")).alias("original_file"))


def folder_decision(document_type: Column, confidence: Column, ocr_score: Column, root: Column) -> Column:
    """struct(folder_name, folder_path, needs_review, review_reason)."""
    names = F.create_map(*[F.lit(x) for kv in K.DRIVE_FOLDERS.items() for x in kv])
    weak = confidence < K.MIN_ROUTING_CONFIDENCE
    folder = F.when(weak, "Uncategorised").otherwise(F.coalesce(F.try_element_at(names, document_type), F.lit("Uncategorised")))
    reasons = F.concat_ws(
        "; ",
        F.when(ocr_score < K.MIN_ROUTING_OCR, F.format_string("low OCR score (%.1f)", ocr_score)),
        F.when(weak, F.concat(F.lit("low classification confidence ("), confidence.cast("string"), F.lit("%)"))),
        F.when(~weak & (folder == "Uncategorised"), F.concat(F.lit("unrecognised document type '"), document_type, F.lit("'"))),
    )
    path = F.concat(F.coalesce(root, F.lit("[Client Root]")), F.lit("/"), folder)
    return F.struct(folder.alias("folder_name"), path.alias("folder_path"), (reasons != "").alias("needs_review"), reasons.alias("review_reason"))


def route(docs: DataFrame) -> DataFrame:
    """``docs`` (document_type, document_confidence, ocr_score, client_id, client_name, match_field, duplicate_type, original_file) with ``action`` and ``action_reason``."""
    f = folder_decision(F.col("document_type"), F.col("document_confidence"), F.col("ocr_score"), F.lit(None).cast("string"))
    d = docs.withColumn("_f", f)
    review = F.col("_f.needs_review") | F.col("client_id").isNull()
    why = F.concat_ws("; ", F.when(F.col("_f.needs_review"), F.col("_f.review_reason")), F.when(F.col("client_id").isNull(), F.lit("no client match")))
    dup = F.col("duplicate_type").isNotNull()
    action = F.when(dup, "skip").when(review, "review").otherwise("upload")
    reason = F.when(dup, F.concat(F.lit("Duplicate ("), F.col("duplicate_type"), F.lit("): matches "), F.col("original_file"))).when(review, why).otherwise(F.concat(F.lit("Matched client '"), F.col("client_name"), F.lit("' via "), F.col("match_field")))
    return d.select(*docs.columns, F.col("_f.folder_name").alias("folder_name"), action.alias("action"), reason.alias("action_reason"))


def batch_summary(results: DataFrame) -> DataFrame:
    """One row: counts by status and by action."""
    count = lambda c, v: F.count_if(F.col(c) == v).alias(f"n_{v}")
    return results.agg(F.count("*").alias("n_files"), *[count("status", v) for v in ("ok", "cached", "error", "missing")], *[count("action", v) for v in ("upload", "review", "skip")])


def split_by_cache(files: DataFrame, cache: DataFrame, key: str = "sha") -> tuple[DataFrame, DataFrame]:
    """Files whose result is cached (with it), and the others."""
    return files.join(cache, key), files.join(cache.select(key), key, "left_anti")
