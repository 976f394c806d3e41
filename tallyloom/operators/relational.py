"""Search, listings, dashboards, sharing and access over the engine's tables, and changes to them.

Tables are never changed in place: a change takes a table and gives the table that follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import constants as K
from tallyloom.functions import text as T
from tallyloom.session import cut

from .documents import spread

# --- search ------------------------------------------------------------------------------------


def search(documents: DataFrame, clients: DataFrame, firm_id: int, term: str, limit: int = 50, texts: DataFrame | None = None) -> DataFrame:
    """A firm's documents whose file name, type, text, client name or PAN contains the term; newest first.

    The term is a LIKE pattern, case folded. Filters reach the scan before the join; the order is a top-k.
    """
    p = f"%{term}%"
    d = documents.where(F.col("firm_id") == firm_id)
    if texts is not None:
        d = d.join(texts.select("id", F.col("text").alias("extracted_text")), "id", "left")
    else:
        d = d.withColumn("extracted_text", F.lit(None).cast("string"))
    c = clients.select(F.col("id").alias("client_id"), "client_name", "pan_number")
    hit = F.lit(False)
    for col in ("filename", "document_type", "extracted_text", "client_name", "pan_number"):
        hit = hit | F.coalesce(F.col(col).ilike(p), F.lit(False))
    return d.join(c, "client_id", "left").where(hit).orderBy(F.desc("uploaded_at"), F.desc("id")).limit(limit).select("id", "filename", "document_type", "client_name", "pan_number", "status", "uploaded_at")


def search_tokens(documents: DataFrame, clients: DataFrame, firm_id: int, tokens: list[str], limit: int = 50) -> DataFrame:
    """Documents of the tokens' searches, each capped at ``limit``: first the first token's, every document once."""
    parts = None
    for i, t in enumerate(tokens):
        one = search(documents, clients, firm_id, t, limit).select("id", "filename", "uploaded_at", F.lit(i).alias("token"))
        parts = one if parts is None else parts.union(one)
    first = parts.groupBy("id", "filename", "uploaded_at").agg(F.min("token").alias("token"))
    return first


def dashboard_counts(documents: DataFrame, clients: DataFrame, firm_id: int) -> DataFrame:
    d = documents.where(F.col("firm_id") == firm_id).agg(F.count("*").alias("n_documents"), F.count_if(F.col("status") == "pending_review").alias("n_pending"), F.count_if(F.col("status") == "approved").alias("n_approved"))
    return d.crossJoin(clients.where(F.col("firm_id") == firm_id).agg(F.count("*").alias("n_clients")))  # one row each


def recent_documents(documents: DataFrame, clients: DataFrame, firm_id: int, limit: int = 10) -> DataFrame:
    d = documents.where(F.col("firm_id") == firm_id).orderBy(F.desc("uploaded_at"), F.desc("id")).limit(limit)
    return d.join(clients.select(F.col("id").alias("client_id"), "client_name"), "client_id", "left").select("id", "filename", "client_name", "uploaded_at")


def audit_parts(action: Column) -> dict[str, Column]:
    """Client, request and result of an audit action, and whether the retrieval missed."""
    p = F.split(action, r" \| ")
    part = lambda i, default: F.coalesce(F.get(p, F.lit(i)), F.lit(default))
    result = part(3, "")
    return {"client_label": part(1, "Unknown client"), "request": part(2, ""), "result": result, "missed": result.contains("No document available") | result.contains("No supported")}


def retrieval_activity(audit: DataFrame, clients: DataFrame, firm_id: int, limit: int = 15) -> DataFrame:
    a = audit.where((F.col("firm_id") == firm_id) & (F.col("entity_type") == "whatsapp_retrieval")).orderBy(F.desc("ts"), F.desc("id")).limit(limit)
    c = clients.select(F.col("id").alias("entity_id"), "client_name")
    return a.join(c, "entity_id", "left").select("id", "client_name", *[v.alias(k) for k, v in audit_parts(F.col("action")).items()], "ts")


def filter_clients(clients: DataFrame, query: str = "", client_type: str = "") -> DataFrame:
    low = F.lit(query.lower())
    hit = F.lower("client_name").contains(low) | F.lower("pan_number").contains(low)
    return clients.where(hit & ((F.col("client_type") == client_type) if client_type else F.lit(True)))


def folder_counts(documents: DataFrame, clients: DataFrame, firm_id: int) -> DataFrame:
    n = documents.where((F.col("firm_id") == firm_id) & F.col("client_id").isNotNull()).groupBy("client_id").agg(F.count("*").alias("n"))
    c = clients.where(F.col("firm_id") == firm_id).select(F.col("id").alias("client_id"), "client_name", "pan_number")
    return c.join(n, "client_id", "left").select("client_id", F.concat_ws("_", "client_name", "pan_number").alias("folder"), F.coalesce("n", F.lit(0)).alias("n_documents"))


def grouped_documents(documents: DataFrame, client_id: int) -> DataFrame:
    """A client's documents by type (no type: Unknown), newest first in each, types in order of first sight."""
    d = documents.where(F.col("client_id") == client_id).withColumn("kind", F.when(F.coalesce("document_type", F.lit("")) == "", "Unknown").otherwise(F.col("document_type")))
    rows = F.collect_list(F.struct((-F.unix_micros(F.col("uploaded_at").cast("timestamp"))).alias("o"), F.col("id"), F.col("filename")))
    g = d.groupBy("kind").agg(F.sort_array(rows).alias("r"), F.count("*").alias("n"), F.min(F.coalesce("document_type", F.lit(""))).alias("_first"))
    return g.select("kind", "n", F.array_join(F.transform("r", lambda x: x["filename"]), ",").alias("filenames"))


def firm_rollup(firms: DataFrame, users: DataFrame, clients: DataFrame) -> DataFrame:
    u = users.groupBy(F.col("firm_id").alias("id")).agg(F.count("*").alias("nu"))
    c = clients.groupBy(F.col("firm_id").alias("id")).agg(F.count("*").alias("nc"))
    return firms.join(u, "id", "left").join(c, "id", "left").select("id", "firm_name", "is_active", F.coalesce("nu", F.lit(0)).alias("n_users"), F.coalesce("nc", F.lit(0)).alias("n_clients"))


# --- sharing and access ------------------------------------------------------------------------


def one_share(access: DataFrame) -> DataFrame:
    """Of each document and recipient the share of highest id."""
    cols = [c for c in access.columns if c not in ("document_id", "shared_with_id")]
    return access.groupBy("document_id", "shared_with_id").agg(F.max_by(F.struct(*cols), "id").alias("m")).select("document_id", "shared_with_id", "m.*")


def shared_with(access: DataFrame, documents: DataFrame, users: DataFrame, user_id: int, mine: bool = False) -> DataFrame:
    """Documents shared with a user and by whom; or, ``mine``, those they shared and with whom."""
    own, other = ("shared_by_id", "shared_with_id") if mine else ("shared_with_id", "shared_by_id")
    a = access.where(F.col(own) == user_id).select(F.col("id").alias("share_id"), "document_id", "permission", F.col("created_at").alias("shared_at"), F.col(other).alias("other_id"))
    d = documents.select(F.col("id").alias("document_id"), "filename")
    return a.join(d, "document_id").join(users.select(F.col("id").alias("other_id"), F.col("full_name").alias("other_name")), "other_id", "left").select("share_id", "document_id", "filename", "permission", "other_name", "shared_at")


def effective_permission(documents: DataFrame, access: DataFrame, user_id: int, as_of: Column, owner: str = "uploaded_by", deleted: str = "is_deleted") -> DataFrame:
    """A user's permission on each document: owner; else the share's unless it has expired by ``as_of``; null for deleted ones."""
    a = one_share(access).where(F.col("shared_with_id") == user_id).select(F.col("document_id").alias("id"), "permission", "expires_at")
    live = F.col("expires_at").isNull() | (F.col("expires_at") >= as_of)
    p = F.when(F.col(deleted), F.lit(None)).when(F.col(owner) == user_id, "owner").when(live, F.col("permission"))
    return documents.join(a, "id", "left").select("id", p.alias("effective"))


def rank_of(name: Column, ranks: dict[str, int], missing: int = 0) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), name), F.lit(missing))


def allowed(effective: Column, required: str) -> Column:
    return rank_of(effective, K.PERMISSION_RANK) >= K.PERMISSION_RANK.get(required, 99)


def session_gate(users: DataFrame, firms: DataFrame) -> DataFrame:
    """Users who may hold a session: active, and super_admin or of an active firm."""
    f = firms.select(F.col("id").alias("firm_id"), F.col("is_active").alias("firm_active"))
    return users.join(f, "firm_id", "left").select("id", (F.col("is_active") & ((F.col("role") == "super_admin") | F.coalesce("firm_active", F.lit(False)))).alias("allowed"))


# --- retrieval by message ----------------------------------------------------------------------


def requested_types(body: Column) -> Column:
    """The document types a message asks for, in order."""
    low = F.lower(F.coalesce(body, F.lit("")))
    return F.filter(F.array(*[F.when(T.contains_any(low, ks), F.lit(t)) for t, ks in K.MESSAGE_KEYWORDS.items()]), lambda t: t.isNotNull())


def type_terms() -> list[tuple[str, str]]:
    """Pairs of requested type and term that a document's type may contain."""
    return [(t, x) for t, ks in K.MESSAGE_KEYWORDS.items() for x in [t.lower(), *ks, *K.MORE_TERMS.get(t, [])]]


def clients_by_phone(messages: DataFrame, clients: DataFrame, blank: bool = False) -> DataFrame:
    """Messages with the active clients whose mobile ends with the phone's last ten digits.

    A mobile is keyed by its suffixes of the lengths that phones have (ten characters at most), so that a
    phone of any length meets its clients by an equi-join; each phone is looked up once, however many
    messages it sends. A phone without digits names nobody. (As an empty suffix it would be every
    client's; ``blank`` asks for that, at the cost of a row for each such message and client.)
    """
    m = messages.withColumn("_p", T.normalize_phone(F.col("phone")))
    c = clients.where("is_active AND mobile IS NOT NULL").select(F.col("id").alias("client_id"), "firm_id", "client_name", F.replace(F.col("mobile"), F.lit(" "), F.lit("")).alias("_m"))
    phones = m.select("_p").where("_p <> ''").distinct()
    lengths = phones.select(F.length("_p").alias("_n")).distinct()  # ten at most
    keyed = c.where(F.length("_m") > 0).withColumn("_n", F.explode(F.sequence(F.lit(1), F.least(F.length("_m"), F.lit(10)))))
    keyed = keyed.join(F.broadcast(lengths), "_n").withColumn("_p", F.right(F.col("_m"), F.col("_n"))).drop("_n")
    found = m.join(phones.join(keyed, "_p").drop("_m"), "_p")
    if blank:
        found = found.unionByName(m.where("_p = ''").crossJoin(c.drop("_m")))
    return found.drop("_p")


def _requests(messages: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Messages with the key ``_request`` of what they ask, and each request once: number, firm, types and year, and the key ``_caller`` of the first two."""
    messages = spread(messages)
    m = messages if "firm_id" in messages.columns else messages.withColumn("firm_id", F.lit(None).cast("int"))
    m = m.select("id", "phone", "body", *keep, F.col("firm_id").alias("_asked"), T.normalize_phone(F.col("phone")).alias("_p"), requested_types(F.col("body")).alias("types"), T.normalize_year(F.col("body")).alias("year"))
    caller = F.concat_ws("|", "_p", F.coalesce(F.col("_asked").cast("string"), F.lit("")))
    request = F.concat_ws("|", caller, F.array_join("types", ","), F.coalesce("year", F.lit("")))
    m = m.withColumn("_request", F.when(F.col("_p") == "", F.concat(F.lit("#"), F.col("id").cast("string"))).otherwise(request))
    wanted = m.where("_p <> ''").groupBy("_request").agg(*[F.first(c).alias(c) for c in ("_p", "_asked", "types", "year")])
    return m, cut(wanted.withColumn("_caller", caller), "requests")


def _callers_clients(wanted: DataFrame, clients: DataFrame) -> DataFrame:
    """The clients of each caller: ``id`` (the caller's key), client_id, client_name, firm_id."""
    callers = wanted.select(F.col("_caller").alias("id"), F.col("_p").alias("phone"), "_asked").distinct()
    return clients_by_phone(callers, clients).where("_asked IS NULL OR firm_id = _asked")


def _matches(wanted: DataFrame, family: DataFrame, documents: DataFrame, file: Column) -> DataFrame:
    """Pairs of ``_request`` and ``file``: documents of the caller's clients (_caller, client_id, firm_id), in the client's firm, of a type asked for and of the year."""
    asked = family.join(wanted.select("_request", "_caller", F.when(F.array_contains("types", "ITR"), F.col("year")).alias("year"), F.explode("types").alias("type")), "_caller")
    low = F.lower("document_type")
    kinds = F.array_distinct(F.filter(F.array(*[F.when(low.contains(term), kind) for kind, term in type_terms()]), lambda k: k.isNotNull()))
    theirs = documents.join(family.select("client_id"), "client_id", "left_semi")
    d = theirs.select("client_id", "firm_id", "assessment_year", file.alias("file"), F.explode(kinds).alias("type"))
    hit = asked.join(d, ["client_id", "firm_id", "type"]).where(F.col("year").isNull() | (T.normalize_year(F.col("assessment_year")) == F.col("year")))
    return hit.select("_request", "file")


def retrieval(messages: DataFrame, clients: DataFrame, documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """For each message (id, phone, body, and firm_id or not) what its sender is shown.

    ``id, client_id, client_name, firm_id, types, year, files, error, reply, action``, and the messages'
    columns in ``keep``: the sender's first client is the one of smallest id (within ``firm_id`` where the
    messages have one that is not null); the documents are those of every client of its firm with the
    number, of the types asked for, newest first (equal times by falling id). Where ITR is asked with a
    year, documents of all types must be of it. ``error`` is why nothing was looked for or left: no
    client, no type in the message, or none of the year. ``reply`` and the audit row's ``action`` follow;
    without client there is no action.

    What is shown depends on the number, the firm, the types and the year alone. Each such request is
    answered once, however many messages make it, and messages meet only the answers.
    """
    keep = keep or []
    m, wanted = _requests(messages, keep)
    found = _callers_clients(wanted, clients)
    who = found.groupBy("id").agg(F.min_by(F.struct("client_id", "client_name", "firm_id"), "client_id").alias("c"))
    family = cut(found.join(who, "id").where("firm_id = c.firm_id").select(F.col("id").alias("_caller"), "client_id", "firm_id", "c").distinct(), "family")
    link = F.when(F.coalesce(F.col("google_drive_file_id"), F.lit("")) != "", F.concat(F.lit(K.DRIVE_LINK), F.col("google_drive_file_id"))) if "google_drive_file_id" in documents.columns else F.lit(None).cast("string")
    file = F.struct((-F.unix_micros(F.col("uploaded_at").cast("timestamp"))).alias("_at"), (-F.col("id")).alias("_id"), F.col("id").alias("document_id"), "filename", "document_type", link.alias("url"))
    files = _matches(wanted, family.drop("c"), documents, file).groupBy("_request").agg(F.sort_array(F.collect_set("file")).alias("files"))
    none = F.array().cast(f"array<struct<document_id:{documents.schema['id'].dataType.simpleString()},filename:string,document_type:string,url:string>>")
    a = wanted.join(family.select("_caller", "c").distinct(), "_caller").join(files, "_request", "left")
    a = a.select("_request", "types", "year", "c", F.coalesce(F.transform("files", lambda f: f.dropFields("_at", "_id")), none).alias("files"))
    empty = F.size("files") == 0
    of_year = F.array_contains("types", "ITR") & F.col("year").isNotNull()
    error = F.when(F.size("types") == 0, K.NO_KEYWORDS).when(empty & of_year, missing_reply(F.col("types"), F.col("year")))
    a = a.withColumn("error", error)
    reply = F.when(F.col("error").isNotNull(), F.col("error")).when(empty, missing_reply(F.col("types"), F.lit(None).cast("string"))).otherwise(document_reply(F.col("files")))
    result = F.when(F.col("error").isNotNull(), F.col("error")).when(empty, K.NO_DOCUMENT).otherwise(F.concat(F.size("files").cast("string"), F.lit(" document(s) found")))
    a = a.select("_request", "c.*", "files", "error", reply.alias("reply"), result.alias("_result"))
    j = m.join(a, "_request", "left")
    action = F.when(F.col("client_id").isNotNull(), audit_action(F.coalesce(F.nullif("client_name", F.lit("")), F.col("_p")), F.col("body"), F.col("_result")))
    unknown = F.when(F.col("client_id").isNull(), K.NO_CLIENT)
    return j.select("id", "client_id", "client_name", "firm_id", "types", "year", F.coalesce("files", none).alias("files"), F.coalesce(unknown, "error").alias("error"), F.coalesce(unknown, "reply").alias("reply"), action.alias("action"), *keep)


def retrieve(messages: DataFrame, clients: DataFrame, documents: DataFrame) -> DataFrame:
    """Pairs (message_id, document_id): the documents asked for, of every client with the sender's number in any firm, each in its own."""
    m, wanted = _requests(messages, [])
    family = cut(_callers_clients(wanted, clients).select(F.col("id").alias("_caller"), "client_id", "firm_id").distinct(), "family")
    files = _matches(wanted, family, documents, F.col("id")).groupBy("_request").agg(F.collect_set("file").alias("files"))
    return m.select("id", "_request").join(files, "_request").select(F.col("id").alias("message_id"), F.explode("files").alias("document_id"))


def audit_action(client: Column, request: Column, result: Column) -> Column:
    ask = F.substring(T.normalize_whitespace(F.coalesce(request, F.lit(""))), 1, 90)
    return F.concat_ws(" | ", F.lit("WhatsApp retrieval"), client, F.when(ask == "", "blank message").otherwise(ask), result)


def document_reply(files: Column) -> Column:
    """Numbered lines of an array of struct(filename, document_type, url)."""
    line = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["filename"], F.lit(" ("), F.coalesce(x["document_type"], F.lit("Unknown")), F.lit(")\n"), F.coalesce(x["url"], F.lit("Drive link unavailable")))
    return F.concat(F.lit("Here are your matching documents:\n"), F.array_join(F.transform(files, line), "\n"))


def missing_reply(types: Column, year: Column, service: str = "our service") -> Column:
    label = F.when(F.size(types) > 0, F.array_join(types, ", ")).otherwise(F.lit("the requested document"))
    return F.concat(F.lit("No document available for "), label, F.coalesce(F.concat(F.lit(" for AY "), year), F.lit("")), F.lit(f" right now. Please ask your CA firm to upload it in {service}."))


# --- changes -----------------------------------------------------------------------------------


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The table with more rows; columns they lack are null."""
    return table.unionByName(rows, allowMissingColumns=True).select(*table.columns)


def insert_children(parents: DataFrame, phones: str, labels: str, key: str = "id") -> DataFrame:
    """A row for each phone of a parent's parallel arrays that is not blank; a blank label is Contact."""
    z = parents.select(F.col(key).alias("client_id"), F.posexplode(F.arrays_zip(F.col(phones).alias("phone"), F.col(labels).alias("label"))).alias("pos", "z"))
    return z.select("client_id", "pos", F.trim("z.phone").alias("phone"), F.coalesce(F.nullif(F.trim("z.label"), F.lit("")), F.lit("Contact")).alias("label")).where("phone <> ''")


def update(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The table with the changes' values of ``columns`` where the key matches; a null value leaves the old one."""
    c = changes.select(F.col(key), *[F.col(x).alias(f"_new_{x}") for x in columns])
    return table.join(c, key, "left").select(*[F.coalesce(f"_new_{x}", x).alias(x) if x in columns else F.col(x) for x in table.columns])


def toggle(table: DataFrame, ids: list[int], column: str = "is_active", key: str = "id") -> DataFrame:
    return table.withColumn(column, F.when(F.col(key).isin(ids), ~F.col(column)).otherwise(F.col(column)))


def toggle_firm(firms: DataFrame, users: DataFrame, firm_id: int) -> tuple[DataFrame, DataFrame]:
    """The firms with one toggled, and the users with those of the firm set to its new state."""
    after = toggle(firms, [firm_id])
    state = after.where(F.col("id") == firm_id).select(F.col("id").alias("firm_id"), F.col("is_active").alias("_state"))
    return after, users.join(state, "firm_id", "left").withColumn("is_active", F.coalesce("_state", "is_active")).drop("_state").select(*users.columns)


def delete(table: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return table.join(gone.select(key), key, "left_anti").select(*table.columns)


def set_null(table: DataFrame, gone: DataFrame, column: str, key: str = "id") -> DataFrame:
    """References to deleted rows become null."""
    g = gone.select(F.col(key).alias(column), F.lit(True).alias("_gone")).distinct()
    return table.join(g, column, "left").withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(*table.columns)


def upsert_shares(access: DataFrame, changes: DataFrame) -> DataFrame:
    """Shares after grants (document_id, shared_with_id, shared_by_id, permission, expires_at, created_at, seq), the last of a key winning.

    An existing share keeps its creator and date; an unknown permission is viewer.
    """
    keys = ["document_id", "shared_with_id"]
    rest = [c for c in changes.columns if c not in keys]
    c = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("n"))
    granted = F.when(F.col("n.permission").isin("viewer", "contributor", "editor"), F.col("n.permission")).otherwise("viewer")
    new = F.col("n").isNotNull()
    j = access.join(c, keys, "full_outer")
    return j.select(*keys, F.coalesce("shared_by_id", "n.shared_by_id").alias("shared_by_id"), F.when(new, granted).otherwise(F.col("permission")).alias("permission"), F.when(new, F.col("n.expires_at")).otherwise(F.col("expires_at")).alias("expires_at"), F.coalesce("created_at", "n.created_at").alias("created_at"))


def approve(documents: DataFrame, approvals: DataFrame) -> DataFrame:
    """Documents after reviews (id, client_id, document_type, assessment_year): their values, and approved."""
    done = update(documents, approvals, "id", ["client_id", "document_type", "assessment_year"])
    ids = approvals.select("id", F.lit("approved").alias("_s"))
    return done.join(ids, "id", "left").withColumn("status", F.coalesce("_s", "status")).select(*documents.columns)


def backfill(table: DataFrame, column: str, value: Column) -> DataFrame:
    return table.withColumn(column, F.coalesce(F.col(column), value))


def add_column(table: DataFrame, column: str, default: Column) -> DataFrame:
    """The column with a default, unless the table has it."""
    return table if column in table.columns else table.withColumn(column, default)


def violations(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def add_members(members: DataFrame, users: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and users after existing users are added to an organization (organization_id, user_id, role).

    Who is a member already is left alone; the others become members and staff of the organization.
    """
    known = users.select(F.col("id").alias("user_id"))
    new = added.join(known, "user_id", "left_semi").join(members, ["organization_id", "user_id"], "left_anti").dropDuplicates(["organization_id", "user_id"])
    mine = new.groupBy(F.col("user_id").alias("id")).agg(F.max("organization_id").alias("organization_id")).withColumn("role", F.lit("staff"))
    return insert(members, new), update(users, mine, "id", ["organization_id", "role"])


def role_gates(users: DataFrame, role_ranks: dict[str, int], org_ranks: dict[str, int], role: str = "role", org_role: str = "org_role", organization: str = "organization_id") -> DataFrame:
    """``id`` and whether each user passes the gates: super admin, professional, organization and its manager."""
    return users.select(
        "id",
        F.coalesce(F.col(role) == "super_admin", F.lit(False)).alias("super_admin"),
        (rank_of(F.col(role), role_ranks) >= role_ranks["professional"]).alias("professional"),
        F.col(organization).isNotNull().alias("organization"),
        (rank_of(F.col(org_role), org_ranks) >= org_ranks["manager"]).alias("org_manager"),
    )
