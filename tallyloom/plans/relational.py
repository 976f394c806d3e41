"""Search, listings, dashboards, sharing, access, retrieval and changes, over the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import constants as K
from tallyloom.functions import text as T
from tallyloom.operators import relational as R

from .registry import Tables, query

AS_OF = "1996-06-01 00:00:00"


def _norm(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '[^0-9]', '', 'g')"


@query("firms clients app_documents", "SELECT f.id, firm_name, client_type, count(d.id) AS n_documents, CAST(coalesce(sum(CASE WHEN status = 'pending_review' THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_pending FROM firms f JOIN clients c ON c.firm_id = f.id JOIN app_documents d ON d.client_id = c.id GROUP BY 1, 2, 3")
def documents_by_client_type(t: Tables) -> DataFrame:
    d = t.app_documents.groupBy("client_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "pending_review").alias("p"))
    c = t.clients.select(F.col("id").alias("client_id"), "firm_id", "client_type").join(d, "client_id").groupBy("firm_id", "client_type").agg(F.sum("n").alias("n_documents"), F.sum("p").alias("n_pending"))
    return c.join(t.firms.select(F.col("id").alias("firm_id"), "firm_name"), "firm_id").select(F.col("firm_id").alias("id"), "firm_name", "client_type", "n_documents", "n_pending")


_SEARCH = """SELECT d.id, filename, document_type, client_name, pan_number, status, uploaded_at FROM app_documents d LEFT JOIN clients c ON c.id = d.client_id {texts}
WHERE d.firm_id = 7 AND (filename ILIKE '%{term}%' OR document_type ILIKE '%{term}%' OR {text} ILIKE '%{term}%' OR client_name ILIKE '%{term}%' OR pan_number ILIKE '%{term}%')
ORDER BY uploaded_at DESC, d.id DESC LIMIT 50"""


@query("clients app_documents", _SEARCH.format(texts="", term="asha", text="CAST(NULL AS VARCHAR)"))
def search_documents(t: Tables) -> DataFrame:
    return R.search(t.app_documents, t.clients, 7, "asha")


@query("clients app_documents ocr_texts", _SEARCH.format(texts="LEFT JOIN ocr_texts o ON o.id = d.id", term="hdfc0", text="o.text"))
def search_documents_text(t: Tables) -> DataFrame:
    return R.search(t.app_documents, t.clients, 7, "hdfc0", texts=t.ocr_texts)


@query(
    "clients app_documents",
    """, hit AS (
SELECT k.token, d.id, filename, uploaded_at, row_number() OVER (PARTITION BY k.token ORDER BY uploaded_at DESC, d.id DESC) AS r
FROM (VALUES (0, 'bina'), (1, 'itr'), (2, 'pan')) k(token, term) JOIN app_documents d ON d.firm_id = 3 LEFT JOIN clients c ON c.id = d.client_id
WHERE filename ILIKE '%' || term || '%' OR document_type ILIKE '%' || term || '%' OR client_name ILIKE '%' || term || '%' OR pan_number ILIKE '%' || term || '%')
SELECT id, filename, uploaded_at, min(token) AS token FROM hit WHERE r <= 50 GROUP BY 1, 2, 3""",
)
def search_expanded_tokens(t: Tables) -> DataFrame:
    return R.search_tokens(t.app_documents, t.clients, 3, ["bina", "itr", "pan"])


@query("clients app_documents", "SELECT count(*) AS n_documents, count(*) FILTER (status = 'pending_review') AS n_pending, count(*) FILTER (status = 'approved') AS n_approved, (SELECT count(*) FROM clients WHERE firm_id = 5) AS n_clients FROM app_documents WHERE firm_id = 5")
def dashboard_counts(t: Tables) -> DataFrame:
    return R.dashboard_counts(t.app_documents, t.clients, 5)


@query("clients app_documents", "SELECT d.id, filename, client_name, uploaded_at FROM app_documents d LEFT JOIN clients c ON c.id = d.client_id WHERE d.firm_id = 5 ORDER BY uploaded_at DESC, d.id DESC LIMIT 10")
def recent_documents(t: Tables) -> DataFrame:
    return R.recent_documents(t.app_documents, t.clients, 5)


@query("clients audit_logs", "SELECT a.id, client_name, string_split(action, ' | ')[2] AS client_label, string_split(action, ' | ')[3] AS request, string_split(action, ' | ')[4] AS result, contains(action, 'No document available') AS missed, ts FROM audit_logs a LEFT JOIN clients c ON c.id = a.entity_id WHERE a.firm_id = 5 AND entity_type = 'whatsapp_retrieval' ORDER BY ts DESC, a.id DESC LIMIT 15")
def retrieval_activity(t: Tables) -> DataFrame:
    return R.retrieval_activity(t.audit_logs, t.clients, 5)


@query("app_documents", "SELECT id, filename, confidence_score FROM app_documents WHERE firm_id = 5 AND status = 'pending_review'")
def review_queue(t: Tables) -> DataFrame:
    return t.app_documents.where("firm_id = 5 AND status = 'pending_review'").select("id", "filename", "confidence_score")


@query("app_documents", "SELECT id, filename, firm_id = 4 AS same_firm FROM app_documents WHERE id IN (1, 2, 3, 34)")
def point_lookup(t: Tables) -> DataFrame:
    return t.app_documents.where(F.col("id").isin(1, 2, 3, 34)).select("id", "filename", (F.col("firm_id") == 4).alias("same_firm"))


@query("clients", "SELECT id, client_name, client_type FROM clients WHERE firm_id = 5")
def client_list(t: Tables) -> DataFrame:
    return t.clients.where("firm_id = 5").select("id", "client_name", "client_type")


@query("clients", "SELECT id, client_name, pan_number FROM clients WHERE (contains(lower(client_name), 'asha') OR contains(lower(pan_number), 'asha')) AND client_type = 'huf'")
def client_filter(t: Tables) -> DataFrame:
    return R.filter_clients(t.clients, "Asha", "huf").select("id", "client_name", "pan_number")


@query("clients app_documents", "SELECT c.id AS client_id, client_name || '_' || pan_number AS folder, count(d.id) AS n_documents FROM clients c LEFT JOIN app_documents d ON d.client_id = c.id AND d.firm_id = 5 WHERE c.firm_id = 5 GROUP BY 1, 2")
def client_folder_counts(t: Tables) -> DataFrame:
    return R.folder_counts(t.app_documents, t.clients, 5)


@query("app_documents", "SELECT coalesce(nullif(document_type, ''), 'Unknown') AS kind, count(*) AS n, string_agg(filename, ',' ORDER BY uploaded_at DESC, id) AS filenames FROM app_documents WHERE client_id = 31 GROUP BY 1")
def client_grouped_documents(t: Tables) -> DataFrame:
    return R.grouped_documents(t.app_documents, 31)


@query("firms users clients app_documents", "SELECT (SELECT count(*) FROM firms) AS n_firms, (SELECT count(*) FROM users) AS n_users, (SELECT count(*) FROM app_documents) AS n_documents")
def admin_totals(t: Tables) -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(t.firms, "n_firms").crossJoin(one(t.users, "n_users")).crossJoin(one(t.app_documents, "n_documents"))  # one row each


@query("users", "SELECT id, full_name, role FROM users ORDER BY id DESC")
def user_list(t: Tables) -> DataFrame:
    return t.users.select("id", "full_name", "role").orderBy(F.desc("id"))


@query("firms users clients", "SELECT f.id, firm_name, is_active, (SELECT count(*) FROM users u WHERE u.firm_id = f.id) AS n_users, (SELECT count(*) FROM clients c WHERE c.firm_id = f.id) AS n_clients FROM firms f")
def firm_rollup_counts(t: Tables) -> DataFrame:
    return R.firm_rollup(t.firms, t.users, t.clients)


@query("document_access app_documents users", "SELECT a.id AS share_id, document_id, filename, permission, full_name AS other_name, created_at AS shared_at FROM document_access a JOIN app_documents d ON d.id = document_id LEFT JOIN users u ON u.id = shared_by_id WHERE shared_with_id = 9")
def shared_with_me(t: Tables) -> DataFrame:
    return R.shared_with(t.document_access, t.app_documents, t.users, 9)


@query("document_access app_documents users", "SELECT a.id AS share_id, document_id, filename, permission, full_name AS other_name, created_at AS shared_at FROM document_access a JOIN app_documents d ON d.id = document_id LEFT JOIN users u ON u.id = shared_with_id WHERE shared_by_id = 9")
def shared_by_me(t: Tables) -> DataFrame:
    return R.shared_with(t.document_access, t.app_documents, t.users, 9, mine=True)


@query("users", "SELECT min(id) AS id FROM users WHERE id <> 3 AND (full_name = 'Supplier#000000004' OR full_name ILIKE '%4')")
def share_target(t: Tables) -> DataFrame:
    return t.users.where("id <> 3 AND (full_name = 'Supplier#000000004' OR full_name ILIKE '%4')").agg(F.min("id").alias("id"))


@query("users clients", "SELECT c.id, client_name, full_name FROM clients c JOIN users u ON u.id = c.id % 10 WHERE c.firm_id = 5 ORDER BY c.id DESC LIMIT 5")
def org_dashboard(t: Tables) -> DataFrame:
    u = t.users.select(F.col("id").alias("k"), "full_name")
    return t.clients.where("firm_id = 5").withColumn("k", F.col("id") % 10).join(u, "k").orderBy(F.desc("id")).limit(5).select("id", "client_name", "full_name")


@query("users firms", "SELECT u.id, full_name, role, firm_name FROM users u JOIN firms f ON f.id = u.firm_id WHERE role <> 'super_admin'")
def staff_list(t: Tables) -> DataFrame:
    f = t.firms.select(F.col("id").alias("firm_id"), "firm_name")
    return t.users.where("role <> 'super_admin'").join(f, "firm_id").select("id", "full_name", "role", "firm_name")


def _numbers(t: Tables) -> DataFrame:
    """Clients' numbers: up to two a client, made from parallel arrays."""
    c = t.clients.where("mobile IS NOT NULL").select("id", F.array(F.col("mobile"), F.lit(" "), F.when(F.col("id") % 3 == 0, F.lit("022-1234")).otherwise(F.lit(""))).alias("phones"), F.array(F.lit("own"), F.lit("x"), F.lit(" ")).alias("labels"))
    return R.insert_children(c, "phones", "labels")


_NUMBERS = "numbers AS (SELECT id AS client_id, 0 AS pos, trim(mobile) AS phone, 'own' AS label FROM clients WHERE mobile IS NOT NULL UNION ALL SELECT id, 2, '022-1234', 'Contact' FROM clients WHERE mobile IS NOT NULL AND id % 3 = 0)"


@query("clients", f", {_NUMBERS} SELECT client_id, pos, phone, label FROM numbers")
def insert_numbers(t: Tables) -> DataFrame:
    return _numbers(t)


@query("clients", f", {_NUMBERS} SELECT c.id, client_name, (SELECT count(*) FROM numbers n WHERE n.client_id = c.id) AS n_numbers FROM clients c WHERE firm_id = 5")
def org_client_auth_counts(t: Tables) -> DataFrame:
    n = _numbers(t).groupBy(F.col("client_id").alias("id")).agg(F.count("*").alias("n"))
    return t.clients.where("firm_id = 5").join(n, "id", "left").select("id", "client_name", F.coalesce("n", F.lit(0)).alias("n_numbers"))


@query("clients", f", {_NUMBERS} SELECT client_id, phone, label FROM numbers WHERE client_id IN (6, 9)")
def client_detail_numbers(t: Tables) -> DataFrame:
    return _numbers(t).where(F.col("client_id").isin(6, 9)).select("client_id", "phone", "label")


@query("users clients", "SELECT id, EXISTS (SELECT 1 FROM clients c WHERE c.firm_id = u.firm_id AND c.client_type = 'huf') AS has_huf FROM users u")
def membership_exists(t: Tables) -> DataFrame:
    c = t.clients.where("client_type = 'huf'").select("firm_id", F.lit(True).alias("h")).distinct()
    return t.users.join(c, "firm_id", "left").select("id", F.coalesce("h", F.lit(False)).alias("has_huf"))


def _owned(t: Tables) -> DataFrame:
    return t.app_documents.select("id", (F.col("id") % 100).alias("uploaded_by"), (F.col("id") % 17 == 0).alias("is_deleted"))


_EFFECTIVE = f"""eff AS (
SELECT d.id, CASE WHEN d.id % 17 = 0 THEN NULL WHEN d.id % 100 = 9 THEN 'owner' WHEN a.id IS NOT NULL AND (expires_at IS NULL OR expires_at >= TIMESTAMP '{AS_OF}') THEN permission END AS effective
FROM app_documents d LEFT JOIN (SELECT * FROM document_access WHERE shared_with_id = 9 QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY id DESC) = 1) a ON a.document_id = d.id)"""


def _effective(t: Tables) -> DataFrame:
    return R.effective_permission(_owned(t), t.document_access, 9, F.lit(AS_OF).cast("timestamp_ntz"))


@query("app_documents document_access", f", {_EFFECTIVE} SELECT id, effective FROM eff WHERE effective IS NOT NULL")
def effective_permission(t: Tables) -> DataFrame:
    return _effective(t).where("effective IS NOT NULL")


@query("app_documents document_access", f", {_EFFECTIVE} SELECT id, coalesce(effective IN ('owner', 'editor', 'contributor'), false) AS can_write, false AS can_fly FROM eff")
def permission_at_least(t: Tables) -> DataFrame:
    return _effective(t).select("id", R.allowed(F.col("effective"), "contributor").alias("can_write"), R.allowed(F.col("effective"), "fly").alias("can_fly"))


@query("app_documents document_access users", "SELECT DISTINCT d.id FROM app_documents d WHERE d.id % 100 = 9 OR (d.id % 5 = 0 AND d.firm_id = (SELECT firm_id FROM users WHERE id = 9)) OR EXISTS (SELECT 1 FROM document_access a WHERE a.document_id = d.id AND a.shared_with_id = 9)")
def accessible_documents(t: Tables) -> DataFrame:
    shared = t.document_access.where("shared_with_id = 9").select(F.col("document_id").alias("id"), F.lit(True).alias("s")).distinct()
    firm = t.users.where("id = 9").select("firm_id", F.lit(True).alias("m"))
    d = t.app_documents.join(shared, "id", "left").join(firm, "firm_id", "left")
    return d.where((F.col("id") % 100 == 9) | ((F.col("id") % 5 == 0) & F.col("m").isNotNull()) | F.col("s").isNotNull()).select("id")


ROLE_RANK = {"super_admin": 100, "professional": 50, "staff": 20, "client": 10, "self_user": 5}  # fixed values


@query("users", "SELECT id, role, CAST(CASE role WHEN 'super_admin' THEN 100 WHEN 'staff' THEN 20 ELSE 0 END AS INTEGER) AS rank FROM users")
def role_rank(t: Tables) -> DataFrame:
    return t.users.select("id", "role", R.rank_of(F.col("role"), ROLE_RANK).alias("rank"))


@query("users firms", "SELECT u.id, u.is_active AND (role = 'super_admin' OR coalesce(f.is_active, false)) AS allowed FROM users u LEFT JOIN firms f ON f.id = u.firm_id")
def session_gate(t: Tables) -> DataFrame:
    return R.session_gate(t.users, t.firms)


@query("users", "SELECT firm_id, min(id) AS user_id FROM users WHERE role = 'firm_admin' GROUP BY firm_id")
def first_firm_admin(t: Tables) -> DataFrame:
    return t.users.where("role = 'firm_admin'").groupBy("firm_id").agg(F.min("id").alias("user_id"))


@query("app_documents", "SELECT id, regexp_matches(lower(filename), '\\.(pdf|jpg|jpeg|png)$') AS allowed FROM app_documents")
def file_type_filter(t: Tables) -> DataFrame:
    return t.app_documents.select("id", F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1)).isin(K.UPLOAD_EXTENSIONS).alias("allowed"))


@query("", "SELECT doc_id, octet_length(encode(text)) <= 5000 AS fits FROM documents")
def size_filter(t: Tables) -> DataFrame:
    return t.base("documents").select("doc_id", (F.octet_length("text") <= 5000).alias("fits"))


# --- retrieval by message ----------------------------------------------------------------------

_TYPES = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(body), '{k}')" for k in ks) + f" THEN '{t}' END" for t, ks in K.MESSAGE_KEYWORDS.items()) + "], lambda x: x IS NOT NULL)"
_YEAR = r"CASE WHEN regexp_matches({x}, '(20)?\d\d\s*[-/]\s*(20)?\d\d') THEN '20' || regexp_extract({x}, '(?:^|[^0-9])(20)?(\d\d)\s*[-/]\s*(20)?(\d\d)', 2) || '-' || regexp_extract({x}, '(?:^|[^0-9])(20)?(\d\d)\s*[-/]\s*(20)?(\d\d)', 4) END"
_PHONE = f"right({_norm('phone')}, 10)"


@query("messages", f"SELECT id, array_to_string({_TYPES}, ',') AS types FROM messages")
def detect_types(t: Tables) -> DataFrame:
    return t.messages.select("id", F.array_join(R.requested_types(F.col("body")), ",").alias("types"))


@query("messages clients", f"SELECT m.id, c.id AS client_id FROM messages m JOIN clients c ON c.is_active AND replace(c.mobile, ' ', '') LIKE '%' || {_PHONE}")
def client_by_phone(t: Tables) -> DataFrame:
    return R.clients_by_phone(t.messages, t.clients).select("id", "client_id")


@query(
    "messages clients app_documents",
    f""", who AS (SELECT m.id AS message_id, c.id AS client_id, c.firm_id, {_TYPES} AS types, {_YEAR.format(x="body")} AS year FROM messages m JOIN clients c ON c.is_active AND replace(c.mobile, ' ', '') LIKE '%' || {_PHONE}),
ask AS (SELECT message_id, client_id, firm_id, CASE WHEN list_contains(types, 'ITR') THEN year END AS year, unnest(types) AS type FROM who),
terms(type, term) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in R.type_terms())})
SELECT DISTINCT message_id, d.id AS document_id FROM ask JOIN terms USING (type) JOIN app_documents d ON d.client_id = ask.client_id AND d.firm_id = ask.firm_id AND contains(lower(document_type), term)
WHERE year IS NULL OR {_YEAR.format(x="assessment_year")} = year""",
)
def retrieval_by_message(t: Tables) -> DataFrame:
    return R.retrieve(t.messages, t.clients, t.app_documents)


@query("messages", f"SELECT id, 'WhatsApp retrieval | ' || {_PHONE} || ' | ' || CASE WHEN trim(body) = '' THEN 'blank message' ELSE body END || ' | No document available' AS action FROM messages")
def audit_append(t: Tables) -> DataFrame:
    return t.messages.select("id", R.audit_action(T.normalize_phone(F.col("phone")), F.col("body"), F.lit("No document available")).alias("action"))


@query("app_documents", "SELECT client_id, 'Here are your matching documents:' || chr(10) || string_agg(CAST(r AS VARCHAR) || '. ' || filename || ' (' || coalesce(document_type, 'Unknown') || ')' || chr(10) || 'Drive link unavailable', chr(10) ORDER BY r) AS reply FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY id) AS r FROM app_documents WHERE firm_id = 5 AND client_id IS NOT NULL) GROUP BY client_id")
def reply_text(t: Tables) -> DataFrame:
    d = t.app_documents.where("firm_id = 5 AND client_id IS NOT NULL").groupBy("client_id").agg(F.sort_array(F.collect_list(F.struct("id", "filename", "document_type", F.lit(None).cast("string").alias("url")))).alias("f"))
    return d.select("client_id", R.document_reply(F.col("f")).alias("reply"))


@query("messages", f"SELECT id, 'No document available for ' || CASE WHEN len({_TYPES}) > 0 THEN array_to_string({_TYPES}, ', ') ELSE 'the requested document' END || coalesce(' for AY ' || {_YEAR.format(x='body')}, '') || ' right now. Please ask your CA firm to upload it in our service.' AS reply FROM messages")
def missing_reply(t: Tables) -> DataFrame:
    return t.messages.select("id", R.missing_reply(R.requested_types(F.col("body")), T.normalize_year(F.col("body"))).alias("reply"))


# --- changes -----------------------------------------------------------------------------------


@query("document_access", "SELECT document_id, shared_with_id, count(*) AS n FROM document_access GROUP BY 1, 2 HAVING count(*) > 1")
def uniqueness_violations(t: Tables) -> DataFrame:
    return R.violations(t.document_access, ["document_id", "shared_with_id"])


@query(
    "document_access",
    """, old AS (SELECT * FROM document_access QUALIFY row_number() OVER (PARTITION BY document_id, shared_with_id ORDER BY id DESC) = 1),
new AS (SELECT document_id + 1 AS document_id, shared_with_id, shared_by_id, CASE WHEN permission = 'viewer' THEN 'boss' ELSE permission END AS permission, expires_at, created_at, id AS seq FROM document_access WHERE id % 50 = 0),
last AS (SELECT * FROM new QUALIFY row_number() OVER (PARTITION BY document_id, shared_with_id ORDER BY seq DESC) = 1)
SELECT coalesce(o.document_id, n.document_id) AS document_id, coalesce(o.shared_with_id, n.shared_with_id) AS shared_with_id, coalesce(o.shared_by_id, n.shared_by_id) AS shared_by_id,
CASE WHEN n.seq IS NULL THEN o.permission WHEN n.permission IN ('viewer', 'contributor', 'editor') THEN n.permission ELSE 'viewer' END AS permission,
CASE WHEN n.seq IS NULL THEN o.expires_at ELSE n.expires_at END AS expires_at, coalesce(o.created_at, n.created_at) AS created_at
FROM old o FULL JOIN last n ON n.document_id = o.document_id AND n.shared_with_id = o.shared_with_id""",
)
def upsert_share(t: Tables) -> DataFrame:
    a = t.document_access
    new = a.where("id % 50 = 0").select((F.col("document_id") + 1).alias("document_id"), "shared_with_id", "shared_by_id", F.when(F.col("permission") == "viewer", "boss").otherwise(F.col("permission")).alias("permission"), "expires_at", "created_at", F.col("id").alias("seq"))
    return R.upsert_shares(R.one_share(a), new)


@query("firms users", "SELECT u.id, u.firm_id, CASE WHEN u.firm_id = 9 THEN NOT (SELECT is_active FROM firms WHERE id = 9) ELSE is_active END AS is_active FROM users u")
def toggle_firm(t: Tables) -> DataFrame:
    return R.toggle_firm(t.firms, t.users, 9)[1].select("id", "firm_id", "is_active")


@query("app_documents", "SELECT id, CASE WHEN id % 40 = 0 THEN 7 ELSE client_id END AS client_id, CASE WHEN id % 40 = 0 THEN 'Invoice' ELSE document_type END AS document_type, assessment_year, CASE WHEN id % 40 = 0 THEN 'approved' ELSE status END AS status FROM app_documents")
def approve_document(t: Tables) -> DataFrame:
    d = t.app_documents
    new = d.where("id % 40 = 0").select("id", F.lit(7).cast("long").alias("client_id"), F.lit("Invoice").alias("document_type"), F.lit(None).cast("string").alias("assessment_year"))
    return R.approve(d, new).select("id", "client_id", "document_type", "assessment_year", "status")


@query("app_documents clients", "SELECT id, CASE WHEN client_id % 10 = 3 THEN NULL ELSE client_id END AS client_id FROM app_documents")
def delete_client(t: Tables) -> DataFrame:
    return R.set_null(t.app_documents, t.clients.where("id % 10 = 3"), "client_id").select("id", "client_id")


@query("app_documents", "SELECT id, filename FROM app_documents WHERE id % 7 <> 0")
def delete_documents(t: Tables) -> DataFrame:
    d = t.app_documents
    return R.delete(d, d.where("id % 7 = 0")).select("id", "filename")


@query("clients", "SELECT id, coalesce(mobile, 'none') AS mobile, 'x' AS drive_folder FROM clients")
def add_column_default(t: Tables) -> DataFrame:
    c = R.backfill(R.add_column(R.add_column(t.clients, "drive_folder", F.lit("x")), "mobile", F.lit("y")), "mobile", F.lit("none"))
    return c.select("id", "mobile", "drive_folder")


@query("clients", "SELECT id, firm_id, client_name FROM clients UNION ALL SELECT -1, 3, 'New Client'")
def insert_client(t: Tables) -> DataFrame:
    new = t.spark.createDataFrame([(-1, 3, "New Client")], "id long, firm_id int, client_name string")
    return R.insert(t.clients, new).select("id", "firm_id", "client_name")
