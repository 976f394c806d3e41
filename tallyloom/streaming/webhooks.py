"""Messages of two messaging services, from payloads to replies, over batches or streams of payloads.

Parsing and answering are plain DataFrame steps, so the same code serves a table of payloads and, by
``foreachBatch``, a stream of them. Nothing is sent: the replies and the audit rows are the result. What
cannot be parsed, a payload or one message of it, becomes a row of status error with what was sent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import constants as K
from tallyloom.operators import relational as R

_MEDIA = "STRUCT<id: STRING, mime_type: STRING, filename: STRING>"
#: A payload of the first service: messages, still as text, below entries and changes.
PAYLOAD = "entry ARRAY<STRUCT<changes: ARRAY<STRUCT<value: STRUCT<messages: ARRAY<STRING>>>>>>, _bad STRING"
MESSAGE = f"`from` STRING, type STRING, text STRUCT<body: STRING>, document {_MEDIA}, image {_MEDIA}, _bad STRING"
_JSON = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}

#: Replies: fixed values.
NO_CLIENT = K.NO_CLIENT
NO_MEDIA_ID = "Could not process this file: media ID missing."
NOT_PROCESSED = "Sorry, this WhatsApp document could not be processed."
SUPPORTED_MEDIA = {"application/pdf": ".pdf", "image/jpeg": ".jpg", "image/png": ".png"}


def payload_stream(spark: SparkSession, folder: str, files_per_batch: int = 100, max_age: str = "7d") -> DataFrame:
    """Payloads that arrive as files in a folder, one in each, as a stream of ``id`` (a hash of all that was sent) and ``value``.

    A file is passed over only if it is older than the newest by more than ``max_age``: so long the
    source remembers names.
    """
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", max_age).load(folder)
    return files.select(F.sha2("value", 256).alias("id"), "value")


def first_deliveries(payloads: DataFrame, within: str = "1 hour") -> DataFrame:
    """Each payload of a stream once: what is delivered again ``within`` that time is left out, in later triggers and after a restart too.

    The time is that of the trigger, so no payload is ever too late, however old its file is. The state
    holds the ids that are younger than the watermark and no others.
    """
    return payloads.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", within).dropDuplicatesWithinWatermark(["id"])


def payload_messages(payloads: DataFrame, key: str = "id") -> DataFrame:
    """``id, n, sender, type, body, media, error, raw`` of every message of the JSON payloads (``key``, value), in order.

    A message that is no object, or whose part for its type is none, has an ``error`` and the others
    stand; a payload that is no JSON of this form is one row with an error.
    """
    p = payloads.select(F.col(key).alias("id"), "value", F.from_json("value", PAYLOAD, _JSON).alias("p"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    texts = "array<string>"
    changes = lambda e: F.flatten(F.transform(none(e["changes"], "array<struct<value:struct<messages:array<string>>>>"), lambda c: none(c["value"]["messages"], texts)))
    found = F.flatten(F.transform("p.entry", changes))
    bad = F.col("p._bad").isNotNull() | F.col("p").isNull()
    one = p.select("id", "value", bad.alias("bad"), F.posexplode(F.when(bad, F.array(F.lit(None).cast("string"))).otherwise(found)).alias("n", "raw"))
    m = one.withColumn("m", F.from_json("raw", MESSAGE, _JSON))
    media = F.when(F.col("m.type") == "document", F.col("m.document")).when(F.col("m.type") == "image", F.col("m.image"))
    lacks = lambda kind: (F.col("m.type") == kind) & F.col(f"m.{kind}").isNull() & F.array_contains(F.json_object_keys("raw"), kind)
    odd = F.col("m._bad").isNotNull() | F.col("m").isNull() | lacks("text") | lacks("document") | lacks("image")
    error = F.when(F.col("bad"), "malformed payload").when(F.coalesce(odd, F.lit(False)), "malformed message")
    return m.select("id", "n", F.col("m.from").alias("sender"), F.col("m.type").alias("type"), F.coalesce("m.text.body", F.lit("")).alias("body"), media.alias("media"), error.alias("error"), F.when(F.col("bad"), F.col("value")).otherwise(F.col("raw")).alias("raw"))


def form_fields(payloads: DataFrame, key: str = "id") -> DataFrame:
    """``id, From, Body, NumMedia, media, value`` of the second service's forms (``key``, value: the url-encoded body).

    ``media`` are the fields MediaUrl0, MediaContentType0 and so on, as many as NumMedia says.
    """
    part = lambda p: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"), F.try_url_decode(F.regexp_extract(p, "=(.*)$", 1)).alias("v"))
    pairs = payloads.select(F.col(key).alias("id"), "value", F.transform(F.split("value", "&"), part).alias("f"))
    get = lambda name: F.get(F.filter("f", lambda x: x["k"] == name), F.lit(0))["v"]
    many = F.greatest(F.coalesce(_count(get("NumMedia")), F.lit(0)), F.lit(0))
    numbered = lambda name, i: get(F.concat(F.lit(name), i.cast("string")))
    media = F.transform(F.slice(F.sequence(F.lit(0), many), F.lit(1), many), lambda i: F.struct(numbered("MediaUrl", i).alias("url"), numbered("MediaContentType", i).alias("content_type")))
    return pairs.select("id", get("From").alias("From"), get("Body").alias("Body"), get("NumMedia").alias("NumMedia"), media.alias("media"), "value")


def _count(x: Column) -> Column:
    """The number of media, 0 where nothing is said; null where it is no number."""
    return F.when(F.coalesce(x, F.lit("")) == "", F.lit(0)).otherwise(F.trim(x).try_cast("int"))


def form_messages(forms: DataFrame, key: str = "id") -> DataFrame:
    """The columns of ``payload_messages`` from forms (``key``, From, Body, NumMedia, media): one text message, or one document for each medium.

    A NumMedia that is no number is an error.
    """
    count = _count(F.col("NumMedia"))
    raw = F.col("value") if "value" in forms.columns else F.lit(None).cast("string")
    media = F.transform(F.slice("media", F.lit(1), F.greatest(count, F.lit(0))), lambda x: F.struct(x["url"].alias("id"), x["content_type"].alias("mime_type"), F.lit(None).cast("string").alias("filename")))
    none = F.array(F.lit(None).cast("struct<id:string,mime_type:string,filename:string>"))
    rows = forms.select(F.col(key).alias("id"), "From", "Body", count.alias("count"), raw.alias("raw"), F.posexplode(F.when(count > 0, media).otherwise(none)).alias("n", "m"))
    named = F.when(F.col("m").isNotNull(), F.col("m").withField("filename", F.concat(F.lit("twilio_whatsapp_"), F.col("n").cast("string"), _extension(F.col("m.mime_type")))))
    error = F.when(F.col("count").isNull(), "malformed form")
    return rows.select("id", "n", F.coalesce("From", F.lit("")).alias("sender"), F.when(F.col("count") > 0, "document").otherwise("text").alias("type"), F.coalesce("Body", F.lit("")).alias("body"), named.alias("media"), error.alias("error"), "raw")


def _extension(mime_type):
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SUPPORTED_MEDIA.items() for x in kv]), mime_type), F.lit(""))


def answers(messages: DataFrame, clients: DataFrame, documents: DataFrame) -> DataFrame:
    """``id, n, sender, status, client_id, n_documents, reply, action, error, raw`` for messages (id, n, sender, type, body, media, error, raw).

    The sender's client is the active one of smallest id whose mobile ends with the sender's number. A
    text searches the documents of all clients of that firm with the number (status searched; see
    ``relational.retrieval``, whose ``action`` is the audit row); a document or image with a media id is to
    be fetched and ingested (status received), without one it is missing_media_id; other types are
    unsupported; a sender without client gets no_client; what was malformed gets error.
    """
    whole = F.col("error").isNull()
    m = messages.select(
        F.concat_ws(":", F.col("id").cast("string"), F.col("n").cast("string")).alias("id"), "n", "sender", "type", F.col("error").alias("_error"),
        F.when(whole, F.col("sender")).alias("phone"), F.when(whole & (F.col("type") == "text"), F.col("body")).alias("body"),
        F.col("media.id").isNotNull().alias("_media"), F.when(~whole, F.col("raw")).alias("raw"),
    )
    found = R.retrieval(m, clients, documents, keep=["n", "sender", "type", "_error", "_media", "raw"])
    fetch = F.coalesce(F.col("type").isin("document", "image"), F.lit(False))
    known = F.col("client_id").isNotNull()
    status = (
        F.when(F.col("_error").isNotNull(), "error")
        .when(~fetch & F.coalesce(F.col("type") != "text", F.lit(True)), "unsupported")
        .when(fetch & ~F.col("_media"), "missing_media_id")
        .when(~known, "no_client").when(fetch, "received").otherwise("searched")
    )
    j = found.withColumn("status", status)
    searched = F.col("status") == "searched"
    reply = F.when(F.col("status") == "no_client", NO_CLIENT).when(F.col("status") == "missing_media_id", NO_MEDIA_ID).when((F.col("status") == "error") & F.col("sender").isNotNull(), NOT_PROCESSED).when(searched, F.col("reply"))
    return j.select("id", "n", "sender", "status", F.when(F.col("status").isin("searched", "received"), F.col("client_id")).alias("client_id"), F.when(searched, F.size("files")).otherwise(0).alias("n_documents"), reply.alias("reply"), F.when(searched, F.col("action")).alias("action"), F.col("_error").alias("error"), "raw")


def answer_stream(payloads: DataFrame, clients: Callable[[], DataFrame], documents: Callable[[], DataFrame], out: str, checkpoint: str, forms: bool = False, within: str = "1 hour"):
    """A running query that answers each batch of a payload stream against the tables as they then are, appended to ``out``.

    What is delivered twice ``within`` that time is answered once. A batch that runs again after a
    failure overwrites its own folder, so that answers are there once.
    """

    def answer(batch: DataFrame, number: int) -> None:
        messages = form_messages(form_fields(batch)) if forms else payload_messages(batch)
        answers(messages, clients(), documents()).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return first_deliveries(payloads, within).writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
