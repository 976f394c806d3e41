"""Scoring, classification and field extraction over a table of texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import constants as K
from tallyloom.functions import text as T

TYPES = list(K.CLASSIFICATION_KEYWORDS)


# --- what is found in a text -------------------------------------------------------------------


@dataclass(frozen=True)
class Seen:
    """A text, lower-cased and upper-cased, and what the patterns shared by scores, types and fields find in it."""

    t: Column
    low: Column
    up: Column
    found: dict[str, Column]

    def has(self, name: str) -> Column:
        return self.found[name].isNotNull()

    def any(self, words: list[str]) -> Column:
        return T.low_contains_any(self.low, words)

    @property
    def year(self) -> Column:
        return self.has("ay") | (F.size(self.found["years"]) > 0)

    @property
    def aadhaar(self) -> Column:
        return self.found["grouped_digits"] | self.found["plain_digits"]


def _look(t: Column, low: Column, up: Column) -> Seen:
    values = {"pan": T.first_match(up, K.PAN), "gstin": T.first_match(up, K.GSTIN), "tan": T.first_match(up, K.TAN), "ifsc": T.first_match(up, K.IFSC), "ay": T.first_match(t, K.AY_LABEL), "itr": T.first_match(t, K.ITR_TYPE)}
    more = {"years": T.all_matches(t, K.AY_ALONE), "grouped_digits": T.has(t, K.AADHAAR_FORMATTED), "plain_digits": T.has(t, K.AADHAAR_PLAIN)}
    counts = {"pairs": F.regexp_count(t, F.lit(T.U + K.KEY_VALUE)), "rows": F.regexp_count(t, F.lit(T.U + K.TABLE_ROW))}
    return Seen(t, low, up, values | more | counts)


def seen(text: Column | Seen) -> Seen:
    """What is found in a text, as expressions over it; what is seen already stays as it is."""
    if isinstance(text, Seen):
        return text
    t = F.coalesce(text, F.lit(""))
    return _look(t, F.lower(t), F.upper(t))


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` over all cores, where so few bytes come in that the scan would give them to a few tasks; larger ones as they are.

    Much work is done on each row here, so rows are worth moving once while they are few.
    """
    spark = docs.sparkSession
    if docs.isStreaming:
        return docs
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(cores) if size < cores * split else docs


def clean_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the text cleaned (see ``functions.text.clean_text``); rows of pure ASCII never reach a Python worker."""
    odd = T.beyond_ascii(F.col(text))
    plain = docs.where(~odd).withColumn(text, T.clean_text(F.col(text), normal_form=False))
    return plain.unionByName(docs.where(odd).withColumn(text, T.clean_text(F.col(text))))


def look_once(docs: DataFrame, text: str = "text") -> tuple[DataFrame, Seen]:
    """``docs`` with helper columns (names start with ``_seen``), so that each pattern runs once a row, and what refers to them."""
    d = spread(docs).withColumn("_seen_t", F.coalesce(F.col(text), F.lit("")))
    d = d.withColumns({"_seen_low": F.lower("_seen_t"), "_seen_up": F.upper("_seen_t")})
    x = _look(*map(F.col, ("_seen_t", "_seen_low", "_seen_up")))
    d = d.withColumns({f"_seen_{k}": v for k, v in x.found.items()})
    return d, Seen(x.t, x.low, x.up, {k: F.col(f"_seen_{k}") for k in x.found})


def forget(docs: DataFrame) -> DataFrame:
    return docs.drop(*[c for c in docs.columns if c.startswith("_seen_")])


# --- scoring -----------------------------------------------------------------------------------


def ocr_score(text: Column | Seen) -> Column:
    """Points for keywords, identifiers, words and structure, less for garbage; 0 for fewer than 10 characters."""
    x = seen(text)
    n = F.length(x.t)
    trimmed = F.length(F.regexp_replace(x.t, r"^\s+|\s+$", ""))
    own = F.lit(0.0)
    for k in K.OCR_SCORE_KEYWORDS:
        own = own + F.when(x.low.contains(k), float(K.SCORE["keyword"])).otherwise(0.0)
    own = own + F.when(x.has("pan"), K.SCORE["pan"]).otherwise(0)
    own = own + F.when(x.found["grouped_digits"] & x.any(K.AADHAAR_WORDS[:3]), K.SCORE["aadhaar"]).otherwise(0)
    own = own + F.when(x.has("gstin"), K.SCORE["gstin"]).otherwise(0)
    own = own + F.when(x.year, K.SCORE["year"]).otherwise(0)
    own = own + F.size(T.words_by_space(x.t)) * F.lit(K.SCORE["word"])
    own = own + T.count_of(x.t, r"\p{L}\p{N}") / n * 100 * F.lit(K.SCORE["alnum"])
    own = own + x.found["pairs"] * K.SCORE["pair"]
    special = F.length(F.regexp_replace(x.t, r"(?U)[\p{L}\p{N}\s.,:;\-/()\[\]'\"]", ""))
    own = own - F.when(special / n > 0.3, K.SCORE["garbage"]).otherwise(0) - F.when(trimmed < 50, K.SCORE["short"]).otherwise(0)
    return F.when(F.coalesce(trimmed, F.lit(0)) < 10, 0.0).otherwise(F.greatest(own, F.lit(0.0)))


def short_circuit(text: Column | Seen, score: Column) -> Column:
    """Whether a pass is good enough to end all others."""
    x = seen(text)
    ids = x.has("pan") | (x.has("itr") & x.year) | x.has("gstin") | (x.any(K.AADHAAR_WORDS[:3]) & x.found["grouped_digits"])
    return F.coalesce((score >= K.SHORT_CIRCUIT) & ids, F.lit(False))


def best_pass(passes: DataFrame, key: str = "file") -> DataFrame:
    """Of each key's passes (pass_no, config, text, score) the one of highest score, the first of equals."""
    best = F.max_by(F.struct("pass_no", "config", "text", "score"), F.struct("score", -F.col("pass_no")))
    return passes.groupBy(key).agg(best.alias("b")).select(key, "b.*")


def scheduled_passes(passes: DataFrame, threshold: float, key: str = "file") -> DataFrame:
    """The passes that run: up to and with the first that reaches the threshold."""
    stop = passes.where(F.col("score") >= threshold).groupBy(key).agg(F.min("pass_no").alias("stop"))
    return passes.join(stop, key, "left").where("stop IS NULL OR pass_no <= stop").drop("stop")


def pass_plan(spark: SparkSession) -> DataFrame:
    """``mode, pass_no, scale, pipeline, psm, config, threshold``: every pass each mode may run, in order.

    Scales go outermost, then the pipelines, plain grey first and the others from cheap to dear, then the
    page modes.
    """
    rows = []
    for mode, m in K.OCR_MODES.items():
        names = ["grayscale_only"] * m["grayscale"] + [p for p in K.OCR_PIPELINES if p in m["pipelines"]]
        every = [(s, p, psm) for s in m["scales"] for p in names for psm in m["psm"]]
        rows += [(mode, n, s, p, psm, f"scale{s}__{p}__psm{psm}", m["stop"]) for n, (s, p, psm) in enumerate(every, 1)]
    return spark.createDataFrame(rows, "mode string, pass_no int, scale double, pipeline string, psm int, config string, threshold double")


def executed_passes(results: DataFrame, key: str = "file") -> DataFrame:
    """Of the results that passes would give (``key``, mode, config, text, score) those of passes that run, with ``pass_no`` and ``short_circuit``.

    A pass ends all later ones, of its scale and of others, if its text is good enough by itself (short
    circuit) or its score reaches the mode's threshold. Passes of other modes and configurations than the
    plan's never run. The stop is a running count within a file, so results are read once and sorted
    once; a file has as many rows as its mode has passes at most.
    """
    plan = F.broadcast(pass_plan(results.sparkSession).select("mode", "config", "pass_no", "threshold"))  # a row for each pass of each mode
    r = results.join(plan, ["mode", "config"])
    short = F.when(F.col("score") >= K.SHORT_CIRCUIT, short_circuit(F.col("text"), F.col("score"))).otherwise(F.lit(False))
    before = Window.partitionBy(key, "mode").orderBy("pass_no").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("short_circuit", short).withColumn("_ends", (F.col("short_circuit") | (F.col("score") >= F.col("threshold"))).cast("int"))
    r = r.withColumn("_ended", F.coalesce(F.sum("_ends").over(before), F.lit(0)))
    return r.where("_ended = 0").drop("_ends", "_ended", "threshold")


def pass_summary(executed: DataFrame, key: str = "file") -> DataFrame:
    """A row a file and mode: how many passes ran, over how many scales, whether a short circuit ended them, and the best pass (the first of equal scores)."""
    best = F.max_by(F.struct("config", "score", "text"), F.struct("score", -F.col("pass_no")))
    scale = F.split_part("config", F.lit("__"), F.lit(1))
    out = executed.groupBy(key, "mode").agg(F.count("*").alias("pass_count"), F.count_distinct(scale).alias("n_scales"), F.bool_or("short_circuit").alias("short_circuit"), best.alias("b"))
    return out.select(key, "mode", "pass_count", "n_scales", "short_circuit", "b.config", "b.score", "b.text")


def is_informative(line: Column) -> Column:
    return F.coalesce((line.contains(":") & (F.length(line) > 5)) | T.contains_any(line, K.INFORMATIVE_WORDS) | F.upper(line).rlike("[A-Z]{5}[0-9]{4}[A-Z]") | line.rlike("(?U)\\d{6,}"), F.lit(False))


def merge_passes(passes: DataFrame, key: str = "file") -> DataFrame:
    """The best pass' text, and below it the informative lines that only other passes have (the first of equal lines)."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), "pass_no")
    ranked = passes.withColumn("_rank", F.row_number().over(order))
    lines = ranked.select(key, "_rank", F.posexplode(F.split("text", "\n")).alias("_pos", "_line")).withColumn("_line", F.regexp_replace("_line", r"^\s+|\s+$", ""))
    lines = lines.where("_line <> ''").withColumn("_low", F.lower("_line"))
    seen = lines.where("_rank = 1").select(key, "_low").distinct()
    new = lines.where("_rank > 1").join(seen, [key, "_low"], "left_anti").where(is_informative(F.col("_line")))
    first = new.groupBy(key, "_low").agg(F.min(F.struct("_rank", "_pos", "_line")).alias("m"))
    more = first.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("m")), lambda m: m["_line"]), "\n").alias("more"))
    base = ranked.where("_rank = 1").select(key, "text")
    return base.join(more, key, "left").select(key, F.when(F.col("more").isNull(), F.col("text")).otherwise(F.concat_ws("\n", "text", F.lit(""), F.lit("[SUPPLEMENTAL LINES]"), "more")).alias("text"))


def quality_flags(metrics: DataFrame) -> DataFrame:
    """Contrast, noise and sharpness flags of image metrics (contrast_std, noise, laplacian), and whether all are good."""
    m = metrics.withColumn("high_contrast", F.col("contrast_std") > 70).withColumn("low_noise", F.col("noise") < 5).withColumn("sharp", F.col("laplacian") > 300)
    return m.withColumn("clean", F.col("high_contrast") & F.col("low_noise") & F.col("sharp"))


# --- classification ----------------------------------------------------------------------------


def keyword_scores(text: Column | Seen) -> dict[str, Column]:
    """Each type's points: the weights of its keywords that the lower-cased text contains."""
    low = seen(text).low
    out = {}
    for t, ks in K.CLASSIFICATION_KEYWORDS.items():
        total = F.lit(0)
        for k, w in ks:
            total = total + F.when(low.contains(k), w).otherwise(0)
        out[t] = total
    return out


def structural_bonus(text: Column | Seen) -> dict[str, Column]:
    """Each type's points for identifiers and structure found in the text."""
    x = seen(text)
    holds = {"pan": x.has("pan"), "aadhaar": x.aadhaar, "pan and aadhaar": x.has("pan") & x.aadhaar, "gstin": x.has("gstin"), "tan": x.has("tan"), "year": x.year, "itr": x.has("itr")}
    out = {}
    for t in TYPES:
        total = F.lit(0)
        for what, least, points in K.STRUCTURE_POINTS.get(t, []):
            when = holds[what] if what in holds else x.found[what] >= least if what in x.found else x.low.contains(what)
            total = total + F.when(when, points).otherwise(0)
        out[t] = total
    return out


def classify(docs: DataFrame, text: str = "text", score: str = "ocr_score") -> DataFrame:
    """``docs`` with ``scores`` (map of type to points), ``document_type`` and ``document_confidence``.

    A text of fewer than 20 characters, or a best type of fewer than 15 points, is Other; the first of
    equal types wins; confidence is at most 60 where the OCR score is under 20.
    """
    d, x = look_once(docs, text)
    return forget(_classify(d, x, score))


def _classify(docs: DataFrame, x: Seen, score: str) -> DataFrame:
    k, b = keyword_scores(x), structural_bonus(x)
    d = docs.withColumn("_points", F.array(*[(k[t] + b[t]).cast("int") for t in TYPES]))
    d = d.withColumns({"_best": F.array_max("_points"), "_total": F.aggregate("_points", F.lit(0), lambda a, p: a + p)})
    first = F.element_at(F.array(*map(F.lit, TYPES)), F.array_position("_points", F.col("_best")).cast("int"))
    short = F.length(F.regexp_replace(x.t, r"^\s+|\s+$", "")) < 20
    weak = F.col("_best") < 15
    ratio = F.least(F.lit(98), (F.col("_best") / F.greatest(F.col("_total"), F.lit(1)) * 100 * 1.5).cast("int"))
    confidence = F.when(F.coalesce(F.col(score), F.lit(0.0)) < 20, F.least(ratio, F.lit(60))).otherwise(ratio)
    return d.select(
        *docs.columns,
        F.when(short, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))).otherwise(F.map_from_arrays(F.array(*map(F.lit, TYPES)), F.col("_points"))).alias("scores"),
        F.when(short | weak, "Other").otherwise(first).alias("document_type"),
        F.when(short, 0).when(weak, F.greatest(F.lit(5), F.col("_best"))).otherwise(confidence).cast("int").alias("document_confidence"),
    )


def refine(docs: DataFrame, text: str | Seen = "text") -> DataFrame:
    """``classify``'s output, with values ``aadhaar``, ``gstin`` and ``pan``, after the ordered rules that identifiers allow."""
    x = text if isinstance(text, Seen) else seen(F.col(text))
    kind, conf = F.col("document_type"), F.col("document_confidence")
    aad = F.col("aadhaar").isNotNull() & ~kind.isin("Aadhaar Card", "PAN Card", "Form 16", "Salary Slip", "ITR Acknowledgement") & x.any(["aadhaar", "uidai"])
    own = F.coalesce(F.try_element_at("scores", kind), F.lit(0))
    other = F.coalesce(F.try_element_at("scores", F.lit("Aadhaar Card")), F.lit(0))
    keep = (conf >= 75) | (own >= other * 3)
    gst = F.col("gstin").isNotNull() & (kind == "Other")
    itr = (kind == "Other") & F.col("pan").isNotNull() & x.year & x.has("itr")
    form = x.has("tan") & x.low.contains("form") & x.t.contains("16") & (kind != "Form 16")
    cert, inv = x.any(["certificate", "registration"]), x.low.contains("invoice")
    new = F.when(aad & keep, kind).when(aad, "Aadhaar Card").when(gst & cert, "GST Certificate").when(gst & inv, "Invoice").when(itr, "ITR Acknowledgement").when(form, "Form 16").otherwise(kind)
    c = F.when(aad & keep, conf).when(aad, F.greatest(conf, F.lit(70))).when(gst & (cert | inv), 65).when(itr, 72).when(form, F.greatest(conf, F.lit(70))).otherwise(conf)
    return docs.select(*[c for c in docs.columns if c not in ("document_type", "document_confidence")], new.alias("document_type"), c.cast("int").alias("document_confidence"))


def status(document_type: Column, client: Column, ambiguous: Column, confidence: Column, score: Column) -> Column:
    sure = client.isNotNull() & ~ambiguous & (confidence >= 70) & (score >= 25)
    return F.when((document_type != "Other") & F.coalesce(sure, F.lit(False)), "auto_classified").otherwise("pending_review")


def legacy_class(text: Column) -> Column:
    """The older rule chain over raw text."""
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    return F.when(F.length(F.trim(t)) < 20, "Unreadable").when(low.contains("enrollment"), "Enrollment Certificate").when(T.contains_any(low, ["aadhaar", "uidai"]) | T.has(t, r"\b\d{4}\s\d{4}\s\d{4}\b"), "Aadhaar").when(T.has(t, K.PAN), "PAN Card").otherwise("Unknown")


# --- extraction --------------------------------------------------------------------------------


def _field(*rules: tuple[Column, Column]) -> Column:
    """The first value that is not null with its confidence, as struct(value, confidence)."""
    value = F.coalesce(*[v for v, _ in rules])
    conf = F.lit(0)
    for v, c in reversed(rules):
        conf = F.when(v.isNotNull(), c).otherwise(conf)
    return F.struct(value.alias("value"), conf.cast("int").alias("confidence"))


def _only(value: Column, ok: Column) -> Column:
    return F.when(ok, value)


def pan_field(text: Column | Seen, s: Column) -> Column:
    x = seen(text)
    t = x.t
    label = F.upper(F.regexp_replace(T.first_match(t, K.PAN_LABEL), r"(?U)\W", ""))
    label = _only(label, T.valid_pan(label))
    strict = x.found["pan"]
    return _field((label, T.field_confidence(label, s, label=True)), (strict, T.field_confidence(strict, s)))


def gstin_field(text: Column | Seen, s: Column) -> Column:
    x = seen(text)
    t = x.t
    label = F.upper(F.regexp_replace(T.first_match(t, K.GSTIN_LABEL), r"(?U)\s", ""))
    label = _only(label, T.valid_gstin(label) & T.valid_pan(F.substring(label, 3, 10)))
    strict = x.found["gstin"]
    return _field((label, T.field_confidence(label, s, label=True)), (strict, T.field_confidence(strict, s)))


def tan_field(text: Column | Seen, s: Column) -> Column:
    x = seen(text)
    t = x.t
    label = F.upper(T.first_match(t, K.TAN_LABEL))
    label = _only(label, F.coalesce(label.rlike("^[A-Z]{4}[0-9]{5}[A-Z]$"), F.lit(False)))
    strict = _only(x.found["tan"], x.any(["tan", "deductor", "form 16"]))
    return _field((label, T.field_confidence(label, s, label=True)), (strict, T.field_confidence(strict, s)))


def ifsc_field(text: Column | Seen, s: Column) -> Column:
    x = seen(text)
    t = x.t
    label = F.upper(T.first_match(t, K.IFSC_LABEL))
    label = _only(label, T.valid_ifsc(label))
    strict = _only(x.found["ifsc"], x.any(["ifsc", "bank", "branch", "account"]))
    return _field((label, T.field_confidence(label, s, label=True)), (strict, T.field_confidence(strict, s)))


def year_field(text: Column | Seen, s: Column) -> Column:
    x = seen(text)
    t = x.t
    ay = x.found["ay"]
    ay = _only(ay, T.valid_year(ay))
    fy = T.first_match(t, K.FY_LABEL)
    fy = _only(fy, T.valid_year(fy))
    alone = F.get(F.filter(x.found["years"], T.valid_year), F.lit(0))
    alone = _only(alone, x.any(["assessment", "financial year", "income tax", "itr", "ay"]))
    return _field((ay, T.field_confidence(ay, s, label=True)), (fy, T.field_confidence(fy, s, label=True)), (alone, T.field_confidence(alone, s)))


def _windows(t: Column, pattern: str, radius: int) -> Column:
    """All matches of group 1 with the text around each, as array of struct(value, near)."""
    p = F.lit(T.U + pattern)
    values = F.regexp_extract_all(t, p, F.lit(1))
    parts = F.split(t, T.U + pattern, -1)
    starts = F.aggregate(F.zip_with(parts, values, lambda a, v: F.struct(F.length(a).alias("a"), F.length(v).alias("n"))), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, x: F.struct((acc["at"] + x["a"] + F.coalesce(x["n"], F.lit(0))).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x["a"])).alias("out")), lambda acc: acc["out"])
    return F.zip_with(values, F.slice(starts, F.lit(1), F.size(values)), lambda v, at: F.struct(v.alias("value"), F.substring(t, F.greatest(at - radius, F.lit(0)) + 1, F.least(at, F.lit(radius)) + F.length(v) + radius).alias("near")))


def aadhaar_field(text: Column | Seen, s: Column) -> Column:
    x = seen(text)
    t = x.t
    label = F.regexp_replace(T.first_match(t, K.AADHAAR_LABEL), r"(?U)\D", "")
    label = T.format_aadhaar(_only(label, T.plausible_aadhaar(label)))
    tail = T.first_match(t, K.AADHAAR_MASKED)
    masked = F.when(tail.isNotNull(), F.concat(F.lit("XXXX XXXX "), tail))
    strong = x.any(K.AADHAAR_WORDS)
    bare = lambda v: F.regexp_replace(v, r"(?U)\D", "")
    grouped = F.filter(_windows(t, K.AADHAAR_FORMATTED, 120), lambda m: T.plausible_aadhaar(bare(m["value"])) & ~T.has(m["near"], K.NOT_AADHAAR))
    grouped = T.format_aadhaar(F.when(strong & x.found["grouped_digits"], F.get(grouped, F.lit(0))["value"]))
    plain = F.filter(_windows(t, K.AADHAAR_PLAIN, 80), lambda m: T.plausible_aadhaar(m["value"]) & T.contains_any(m["near"], K.AADHAAR_WORDS) & ~T.has(m["near"], K.NOT_AADHAAR))
    plain = T.format_aadhaar(F.when(strong & x.found["plain_digits"], F.get(plain, F.lit(0))["value"]))
    return _field((label, T.field_confidence(label, s, label=True)), (masked, F.lit(60)), (grouped, T.field_confidence(grouped, s)), (plain, T.field_confidence(plain, s, corrected=True)))


def name_field(text: Column | Seen, s: Column, pan: Column) -> Column:
    """The first valid name near the PAN, else the first after a label, else the first fitting top line.

    A later place is only looked at where the earlier ones have none, and a label's pattern only runs on texts that hold the label.
    """
    x = seen(text)
    t = x.t
    good = lambda c: (c != "") & T.is_likely_name(c) & T.is_valid_name(c)
    tidy = lambda v: T.clean_name(F.trim(F.get(F.split(F.trim(v), "\n"), F.lit(0))))
    first = lambda a: F.get(F.filter(a, good), F.lit(0))
    value = r"\s*[:\-\|]?\s*([A-Za-z][A-Za-z\s\.\-]{2,50})"
    found = lambda text, label: first(F.transform(F.regexp_extract_all(text, F.lit(label + value), F.lit(1)), tidy))
    labelled = F.coalesce(*[F.when(x.low.contains(label), found(t, rf"(?i)(?<![A-Za-z])(?:{label})(?![A-Za-z])")) for label in K.NAME_LABELS])

    def around(p: Column) -> Column:
        at = F.position(p, x.up)
        window = F.when(p.isNotNull() & (at > 0), F.substring(t, F.greatest(at - 300, F.lit(1)), F.least(at - 1, F.lit(300)) + F.length(p) + 200))
        return F.coalesce(window, F.lit(""))

    near = T.once(T.once(pan, around), lambda w: F.coalesce(*[found(w, rf"(?i)(?:{label})") for label in ("name", "assessee", "applicant")]))
    line = lambda v: F.length(v).between(4, 60) & v.rlike(r"(?U)[^\d\W]") & ~T.contains_any(v, K.TOP_LINE_WORDS) & ~F.regexp_replace(F.lower(F.get(T.words_by_space(v), F.lit(0))), r"[.,:\-]+$", "").isin(K.TOP_LINE_STOPWORDS) & (T.count_of(v, r"\p{L}") / F.length(v) >= 0.7)
    top = F.transform(F.filter(F.slice(T.lines_of(t), F.lit(1), F.lit(12)), line), T.clean_name)
    top = first(F.filter(top, lambda c: F.size(T.words_by_space(c)) >= 2))
    conf = T.field_confidence(F.lit("x"), s, regex=False, label=True)
    place = lambda v, points: T.once(v, lambda n: F.when(n.isNotNull(), F.struct(n.alias("name"), points.cast("int").alias("points"))))
    best = F.coalesce(place(near, conf + 10), place(labelled, conf), place(top, F.lit(40)))
    none = F.struct(F.lit(None).cast("string").alias("value"), F.lit(0).alias("confidence"))
    given = lambda v: T.once(T.normalize_name(v["name"]), lambda n: F.when(T.is_valid_name(n), F.struct(n.alias("value"), v["points"].alias("confidence"))).otherwise(none))
    return F.coalesce(T.once(best, given), none)


def phone_field(t: Column) -> Column:
    label = F.right(T.digits(T.first_match(t, K.PHONE_LABEL)), F.lit(10))
    label = _only(label, label.rlike("^[6-9][0-9]{9}$"))
    return _field((label, F.lit(75)), (T.first_match(t, K.PHONE), F.lit(55)))


def simple_field(t: Column, pattern: str, confidence: int, lower: bool = False) -> Column:
    v = T.first_match(t, pattern)
    return _field((F.lower(v) if lower else v, F.lit(confidence)))


def dates_field(t: Column) -> Column:
    """Dates with month names, then numeric ones, each once, as written."""
    return F.array_distinct(F.concat(T.all_matches(t, K.DATE_MONTH), T.all_matches(t, K.DATE_NUMERIC)))


def gst_period_field(text: Column | Seen) -> Column:
    x = seen(text)
    t, gst = x.t, T.about_gst(x.low)
    month, filed = _only(T.first_match(t, K.GST_PERIOD), gst), _only(T.first_match(t, K.GST_FILED), gst)
    return F.struct(month.alias("month"), filed.alias("filing_date"), F.when(month.isNotNull() | filed.isNotNull(), 85).otherwise(0).cast("int").alias("confidence"))


def itr_type(text: Column | Seen) -> Column:
    """The first ITR form, written with a dash; what ``found`` calls itr may also be a word that begins with these letters."""
    x = seen(text)
    form = F.when(x.has("itr"), T.first_match(x.t, K.ITR_FORM))
    return F.replace(F.replace(F.upper(form), F.lit(" "), F.lit("-")), F.lit("--"), F.lit("-"))


def extract_fields(docs: DataFrame, text: str = "text", score: str = "ocr_score") -> DataFrame:
    """``docs`` with one column a field: struct(value, confidence), and ``dates``."""
    d, x = look_once(docs, text)
    return forget(_extract(d, x, score))


def id_fields(x: Seen, s: Column) -> dict[str, Column]:
    """The fields that need nothing but the text and its score."""
    return {"pan": pan_field(x, s), "aadhaar": aadhaar_field(x, s), "gstin": gstin_field(x, s), "tan": tan_field(x, s), "ifsc": ifsc_field(x, s), "year": year_field(x, s)}


def other_fields(x: Seen, s: Column, pan: Column) -> dict[str, Column]:
    """The further fields of struct(value, confidence); the name is looked for near the PAN."""
    t = x.t
    return {
        "name": name_field(x, s, pan),
        "invoice_number": _field((T.first_match(t, K.INVOICE_LABEL), T.field_confidence(F.lit("x"), s, label=True))),
        "phone": phone_field(t),
        "email": simple_field(t, K.EMAIL, 90, lower=True),
        "itr_type": _field((itr_type(x), F.lit(85))),
        "acknowledgement_number": simple_field(t, K.ACK_LABEL, 85),
    }


def _extract(docs: DataFrame, x: Seen, score: str) -> DataFrame:
    s = F.col(score)
    d = docs.withColumns(id_fields(x, s))
    return d.withColumns(other_fields(x, s, F.col("pan.value")) | {"dates": dates_field(x.t), "gst_period": gst_period_field(x)})


def process(docs: DataFrame, text: str = "text", score: str = "ocr_score") -> DataFrame:
    """Classify, extract, refine and summarise: the whole pipeline from corrected text to one result row."""
    d, x = look_once(docs, text)
    d = _extract(_classify(d, x, score), x, score)
    ids = {k: F.col(f"{k}.value") for k in ("aadhaar", "gstin", "pan")}
    kept = [c for c in d.columns if c not in ids]
    flat = refine(d.select(*kept, *[F.col(k).alias(f"_{k}") for k in ids], *[v.alias(k) for k, v in ids.items()]), x)
    out = flat.select(*[c for c in flat.columns if c not in ids and c not in {f"_{k}" for k in ids}], *[F.col(f"_{k}").alias(k) for k in ids])
    parts = {"Name": F.col("name.value"), "PAN": F.col("pan.value"), "Aadhaar": F.col("aadhaar.value"), "GSTIN": F.col("gstin.value"), "Assessment_Year": F.col("year.value"), "ITR_Type": F.col("itr_type.value")}
    return forget(out.withColumn("summary", T.summary_line(F.col("document_type"), F.col("document_confidence"), **parts)))


def legacy_ids(docs: DataFrame, text: str = "text") -> DataFrame:
    """The older extractor's identifiers as columns; null without a match."""
    t = F.col(text)
    return docs.withColumns({"pan": T.first_match(F.upper(t), K.PAN), "aadhaar": T.first_match(t, r"\b([2-9]\d{3}\s?\d{4}\s?\d{4})\b"), "gstin": T.first_match(F.upper(t), K.GSTIN), "ifsc": T.first_match(F.upper(t), K.IFSC), "assessment_year": T.first_match(t, r"\b(20\d{2}\s?[-–]\s?\d{2})\b")})
