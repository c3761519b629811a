"""The registered queries: each applies library operators to the given tables, beside SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import functions as fn
from .kept import shared_folder
from .operators import catalog, checked, integrity, inverted_index, mutate, ordered, report, retrieval, session, text, validate, vector_cells
from .sources import append_stream, read_table
from .streaming import rate_limit
from .streaming.stateful import PARTS, rate_limit_stream, token_use_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
c, lit = F.col, F.lit
NOW = "2024-01-20 00:00:00"


def query(sql: str):
    """Register a function of a table reader under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, folder: f(lambda name: read_table(spark, folder, name))
        ORACLES[f.__name__] = sql
        return QUERIES[f.__name__]

    return register


def _now():
    return F.to_timestamp_ntz(lit(NOW))


_W = "'" + "' || '".join([" "]) + "' || " + " || ".join(f"chr({ord(x)})" for x in fn.WHITE)


@query("SELECT doc_id, (i / 450)::INT AS chunk_no, i::INT AS start, substr(text, i + 1, 500) AS chunk FROM (SELECT doc_id, text, unnest(range(0, length(text), 450)) AS i FROM documents)")
def chunk_documents(t):
    return text.chunk_documents(t("documents"))


@query("SELECT doc_id, coalesce(length(text), 0)::BIGINT AS characters, ceil(coalesce(length(text), 0) / 450.0)::BIGINT AS chunks FROM documents")
def ingest_summary(t):
    return text.ingest_summary(t("documents"))


@query("SELECT conv_id, count(*) AS pages, sum(length(coalesce(text, '')))::BIGINT AS characters, ceil(sum(length(coalesce(text, ''))) / 450.0)::BIGINT AS chunks FROM conversations GROUP BY conv_id")
def ingest_report(t):
    return text.ingest_report(t("conversations"), "conv_id", "text")


@query("SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS content, count(*) AS pages FROM conversations GROUP BY conv_id")
def ordered_concat(t):
    return text.ordered_concat(t("conversations"), "conv_id", "turn", "text")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_custkey = 7")
def owner_listing(t):
    return catalog.owner_listing(t("orders"), "o_custkey", 7, "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT o_custkey, o_orderkey, r AS rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)::INT AS r FROM orders) WHERE r <= 3")
def owner_listing_all(t):
    return catalog.newest_per_owner(t("orders"), "o_custkey", "o_orderdate", "o_orderkey", 3).select("o_custkey", "o_orderkey", "rank")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 10")
def newest_k(t):
    return catalog.newest_k(t("events"), "ts", "event_id", 10).select("event_id", "user_id", "event_type")


@query("SELECT k AS c_custkey, c_name, c_custkey IS NOT NULL AS found FROM (SELECT DISTINCT o_custkey + 1000 AS k FROM orders) LEFT JOIN customer ON k = c_custkey")
def lookup_by_key(t):
    return catalog.lookup(t("orders").select((c("o_custkey") + 1000).alias("c_custkey")), t("customer").select("c_custkey", "c_name"), "c_custkey")


@query("SELECT k AS c_custkey, c_custkey IS NOT NULL AS found FROM (SELECT DISTINCT o_custkey + 1000 AS k FROM orders) LEFT JOIN customer ON k = c_custkey")
def exists_flags(t):
    return catalog.exists_flags(t("orders").select((c("o_custkey") + 1000).alias("c_custkey")), t("customer"), "c_custkey")


@query("SELECT 'stored_objects/' || doc_id AS object_address, strlen(text)::INT AS content_size_bytes, sha256(text) AS sha256_checksum FROM documents")
def object_metadata(t):
    rows = catalog.register_objects(t("documents"), c("text"), c("doc_id"), "stored_objects", _now())
    return rows.select("object_address", "content_size_bytes", "sha256_checksum")


@query("SELECT 'stored_objects/' || k AS object_address, d.doc_id IS NOT NULL AS found, d.n_chars AS content_size, d.source AS original_filename FROM (SELECT DISTINCT doc_id + 100 AS k FROM documents) LEFT JOIN documents d ON d.doc_id = k")
def metadata_lookup(t):
    registry = t("documents").select(fn.object_address("stored_objects", c("doc_id")).alias("object_address"), c("n_chars").alias("content_size"), c("source").alias("original_filename"), c("text").alias("data"))
    asked = t("documents").select(fn.object_address("stored_objects", c("doc_id") + 100).alias("object_address"))
    return catalog.metadata(asked, registry, "object_address", ["content_size", "original_filename"])


@query(f"SELECT 'stored_objects/' || doc_id AS object_address, NULL::VARCHAR AS content_type, strlen(text)::INT AS content_size_bytes, sha256(text) AS sha256_checksum, '{NOW}' AS created_at FROM documents")
def object_register(t):
    return catalog.register_objects(t("documents"), c("text"), c("doc_id"), "stored_objects", lit(NOW))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def text_digest(t):
    return t("documents").select("doc_id", fn.digest(c("text")).alias("digest"))


@query("SELECT sha256(text) AS checksum, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_content(t):
    return integrity.duplicate_content(t("documents"), c("text"), "doc_id")


@query(f"SELECT event_id FROM events WHERE event_type <> 'error' AND ts + INTERVAL 10 DAY > TIMESTAMP '{NOW}'")
def valid_at(t):
    return t("events").where(session.valid_at(c("event_type") == "error", fn.expires(c("ts"), 10), _now())).select("event_id")


@query("SELECT event_id, strftime(ts + INTERVAL 30 DAY, '%Y-%m-%d %H:%M:%S') AS refresh_until, strftime(ts + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS access_until FROM events")
def expiry_times(t):
    shown = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")
    return t("events").select("event_id", shown(fn.expires(c("ts"), 30)).alias("refresh_until"), shown(fn.expires(c("ts"), 0, 30)).alias("access_until"))


def _attempts(t):
    own = t("events").select("event_id", F.concat_ws(":", c("user_id").cast("string"), "event_type").alias("token"), "ts", (c("event_type") == "error").alias("revoked"), _now().alias("expires_at"))
    return session.single_use(own, "token", "ts", "event_id", "revoked", "expires_at")


_WON = f"SELECT event_id, user_id || ':' || event_type AS token, ts, event_type <> 'error' AND ts < TIMESTAMP '{NOW}' AND row_number() OVER (PARTITION BY user_id, event_type ORDER BY (event_type <> 'error' AND ts < TIMESTAMP '{NOW}') DESC, ts, event_id) = 1 AS won FROM events"


@query(f"SELECT event_id, token, won FROM ({_WON})")
def single_use_consume(t):
    return _attempts(t).select("event_id", "token", "won")


@query(f"SELECT sha256(token || '|' || ts::VARCHAR) AS token, strftime(ts + INTERVAL 30 DAY, '%Y-%m-%d %H:%M:%S') AS expires_at FROM ({_WON}) WHERE won")
def rotate_tokens(t):
    return session.rotate(_attempts(t), "token", "ts").select("token", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"))


def _tokens(t):
    """A token of each user and kind of event: made at the first one, for three days; tokens of errors are revoked."""
    named = t("events").select("event_id", F.concat_ws(":", c("user_id").cast("string"), "event_type").alias("token"), "ts")
    kept = named.groupBy("token").agg((F.min("ts") + F.make_dt_interval(lit(3))).alias("expires_at")).withColumn("revoked", c("token").endswith(":error"))
    return kept, named.where("event_id % 3 > 0")


_TOKENS = """k AS (SELECT user_id || ':' || event_type AS token, min(ts) + INTERVAL 3 DAY AS expires_at, event_type = 'error' AS revoked FROM events GROUP BY user_id, event_type),
a AS (SELECT event_id, user_id || ':' || event_type AS token, ts FROM events WHERE event_id % 3 > 0),
w AS (SELECT event_id, token, ts FROM (SELECT event_id, token, ts, row_number() OVER (PARTITION BY token ORDER BY ts, event_id) AS r FROM a JOIN k USING (token) WHERE NOT revoked AND expires_at > ts) WHERE r = 1)"""


@query(f"WITH {_TOKENS} SELECT k.token, strftime(expires_at, '%Y-%m-%d %H:%M:%S') AS expires_at, revoked OR w.token IS NOT NULL AS revoked, w.event_id AS used_by FROM k LEFT JOIN w USING (token)")
def consume_tokens(t):
    after, won = session.consume(*_tokens(t), "token", "ts", "event_id")
    return after.join(won.select("token", c("event_id").alias("used_by")), "token", "left").select("token", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"), "revoked", "used_by")


@query(f"WITH {_TOKENS} SELECT k.token, strftime(expires_at, '%Y-%m-%d %H:%M:%S') AS expires_at, revoked OR w.token IS NOT NULL AS revoked FROM k LEFT JOIN w USING (token) UNION ALL SELECT sha256(token || '|' || ts::VARCHAR), strftime(ts + INTERVAL 30 DAY, '%Y-%m-%d %H:%M:%S'), false FROM w")
def rotate_state(t):
    return session.rotated(*_tokens(t), "token", "ts", "event_id").select("token", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"), "revoked")


@query("SELECT user_id, sha256('s' || event_id) AS token, '2024-02-19 00:00:00' AS expires_at, false AS revoked FROM events WHERE event_type = 'signup'")
def issue_tokens(t):
    users = t("events").where("event_type = 'signup'")
    new = session.issue(users, "user_id", F.concat(lit("s"), c("event_id").cast("string")), _now())
    return new.withColumn("expires_at", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss"))


@query(f"WITH {_TOKENS} SELECT token, revoked, revoked OR (expires_at > TIMESTAMP '{NOW}' AND token IN (SELECT token FROM a)) AS after FROM k")
def revoke_valid(t):
    tokens, keys = _tokens(t)
    after = session.revoke_valid(tokens, keys, "token", _now()).select("token", c("revoked").alias("after"))
    return tokens.select("token", "revoked").join(after, "token")


@query("SELECT 'found' AS part, doc_id, sha256(text) AS digest FROM documents WHERE doc_id IN (SELECT doc_id * 2 FROM labels) UNION ALL SELECT DISTINCT 'missing', doc_id * 2, NULL FROM labels WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents)")
def payload_lookup(t):
    found, missing = catalog.payloads(t("labels").select((c("doc_id") * 2).alias("doc_id")), t("documents"), "doc_id", "text")
    return found.select(lit("found").alias("part"), "doc_id", F.sha2("text", 256).alias("digest")).unionByName(missing.select(lit("missing").alias("part"), "doc_id", lit(None).cast("string").alias("digest")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'R' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def flag_update(t):
    keys = t("lineitem").where("l_returnflag = 'R'").select(c("l_orderkey").alias("o_orderkey"))
    return mutate.flag_update(t("orders").select("o_orderkey", "o_orderstatus"), keys, "o_orderkey", "o_orderstatus", lit("R"))


@query("SELECT o_orderkey, CASE WHEN o_custkey = 7 THEN 'R' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def rewritten_orders(t):
    """The orders lie in files by customer; only those that have one of customer 7 are written anew."""
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    path = f"{shared_folder(orders.sparkSession)}/orders-{uuid.uuid4().hex}"
    orders.repartitionByRange("o_custkey").write.parquet(f"{path}/v1")
    keys = orders.sparkSession.createDataFrame([(7,)], "o_custkey long")
    change = lambda rows: mutate.flag_update(rows, keys, "o_custkey", "o_orderstatus", lit("R"))
    return checked.rewrite_touched(orders.sparkSession, [f"{path}/v1"], keys, "o_custkey", change, f"{path}/v2").rows.select("o_orderkey", "o_orderstatus")


@query("SELECT doc_id, CASE WHEN s IS NULL THEN 'missing_subject' WHEN try_cast(s AS BIGINT) IS NULL THEN 'invalid_token' WHEN c_custkey IS NULL THEN 'user_not_found' WHEN c_acctbal < 0 OR c_acctbal IS NULL THEN 'inactive_user' ELSE 'accepted' END AS reason FROM (SELECT doc_id, nullif(CASE WHEN doc_id % 5 = 0 THEN source ELSE regexp_replace(source, '[^0-9]', '', 'g') END, '') AS s FROM documents) LEFT JOIN customer ON try_cast(s AS BIGINT) = c_custkey")
def access_reason(t):
    subject = F.nullif(F.when(c("doc_id") % 5 == 0, c("source")).otherwise(F.regexp_replace("source", "[^0-9]", "")), lit(""))
    users = t("customer").select(c("c_custkey").alias("id"), (c("c_acctbal") >= 0).alias("is_active"))
    return catalog.access_reason(t("documents").select("doc_id", subject.alias("subject")), users).select("doc_id", "reason")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def role_gate(t):
    return catalog.role_gate(t("customer"), "c_mktsegment", "BUILDING").select("c_custkey")


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS role FROM customer")
def public_profile(t):
    return catalog.public_view(t("customer"), {"c_custkey": "id", "c_name": "name", "c_mktsegment": "role"})


@query("""SELECT '{"id":' || c_custkey || ',"drug_name":"' || c_name || '","manufacturer":' || CASE WHEN c_acctbal < 0 THEN 'null' ELSE '"' || c_mktsegment || '"' END || ',"status":"pending"}' AS response FROM customer""")
def row_to_response(t):
    rows = t("customer").select(c("c_custkey").alias("id"), c("c_name").alias("drug_name"), F.when(c("c_acctbal") >= 0, c("c_mktsegment")).alias("manufacturer"), lit("pending").alias("status"), "c_acctbal")
    return catalog.responses(rows, ["id", "drug_name", "manufacturer", "status"])


@query("SELECT conv_id, turn, role FROM conversations WHERE role NOT IN ('user', 'system') OR role IS NULL")
def enum_violations(t):
    return t("conversations").where(validate.outside_domain(c("role"), ["user", "system"])).select("conv_id", "turn", "role")


@query("SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '400 name' WHEN page_id % 7 = 1 THEN '400 file' WHEN page_id % 7 = 2 THEN '415 type' WHEN page_id % 7 = 3 THEN '400 empty' WHEN page_id % 7 <> 4 AND strlen(html) > 4000 THEN '413' WHEN page_id % 7 = 4 OR NOT starts_with(html, '<!DOCTYPE') THEN '415 magic' ELSE '201' END AS outcome FROM pages")
def upload_outcome(t):
    kind = c("page_id") % 7
    name = F.when((kind == 0) & (c("page_id") % 2 == 0), lit(" \t")).when(kind != 0, c("url"))
    body = F.when(kind == 3, lit("")).when(kind == 4, F.left("html", lit(4))).otherwise(c("html"))
    outcome = validate.upload_outcome(name, kind != 1, F.when(kind == 2, lit("image/png")).otherwise(lit("text/html")), F.octet_length(body), F.startswith(body, lit("<!DOCTYPE")), "text/html", 4000)
    return t("pages").select("page_id", outcome.alias("outcome"))


_RULES = r"""list_filter([CASE WHEN x IS NULL THEN 'missing' END, CASE WHEN length(x) < 8 THEN 'too_short' END, CASE WHEN length(x) > 64 THEN 'too_long' END, CASE WHEN NOT regexp_matches(x, '[A-Z]') THEN 'uppercase' END, CASE WHEN NOT regexp_matches(x, '[a-z]') THEN 'lowercase' END, CASE WHEN NOT regexp_matches(x, '\p{Nd}') THEN 'digit' END, CASE WHEN NOT regexp_matches(x, '[!@#$%^&*(),.?":{}|<>]') THEN 'special' END], lambda r: r IS NOT NULL)"""


@query(f"SELECT doc_id, line_no, array_to_string(v, ',') AS every_violation, coalesce(v[1], '') AS first_violation FROM (SELECT doc_id, line_no, {_RULES} AS v FROM (SELECT doc_id, (i - 1)::INT AS line_no, lines[i] AS x FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))))")
def text_rules(t):
    found = validate.line_violations(t("documents"))
    return found.select("doc_id", "line_no", F.array_join("violations", ",").alias("every_violation"), F.coalesce(F.get("violations", lit(0)), lit("")).alias("first_violation"))


@query("SELECT doc_id, length(source) < 32 OR lower(source) = 'web-000' AS weak FROM documents")
def weak_secret(t):
    return t("documents").select("doc_id", validate.weak_secret(c("source"), ["WEB-000"]).alias("weak"))


@query(r"SELECT page_id, regexp_full_match(address, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS ok FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN page_id || '@' || regexp_extract(url, '//([^/]+)', 1) WHEN page_id % 3 = 1 THEN 'a b@c.org' ELSE url END AS address FROM pages)")
def email_like(t):
    address = F.when(c("page_id") % 3 == 0, F.concat_ws("@", c("page_id").cast("string"), F.regexp_extract("url", "//([^/]+)", 1))).when(c("page_id") % 3 == 1, lit("a b@c.org")).otherwise(c("url"))
    return t("pages").select("page_id", fn.email_like(address).alias("ok"))


@query("SELECT page_id, starts_with(html, '<!DOCTYPE') AS ok FROM pages")
def magic_bytes(t):
    return t("pages").select("page_id", fn.has_magic(F.encode("html", "UTF-8"), b"<!DOCTYPE").alias("ok"))


@query("SELECT event_id, array_to_string(list_sort(list_filter(json_keys(props), lambda k: k <> 'page')), ',') AS unknown FROM events WHERE len(list_filter(json_keys(props), lambda k: k <> 'page')) > 0")
def unknown_keys(t):
    rows = t("events").select("event_id", validate.unknown_keys(c("props"), ["page"]).alias("u"))
    return rows.where(F.size("u") > 0).select("event_id", F.array_join("u", ",").alias("unknown"))


@query("SELECT doc_id, CASE WHEN text IS NULL THEN 'inserted' WHEN row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id) > 1 OR lower(text) IN (SELECT lower(text) FROM benchmark) THEN 'conflict' ELSE 'inserted' END AS outcome FROM documents")
def insert_conflicts(t):
    incoming = t("documents").select("doc_id", F.sha2(F.lower("text"), 256).alias("k"))
    return mutate.insert_conflicts(incoming, t("benchmark").select(F.sha2(F.lower("text"), 256).alias("k")), "k", "doc_id").select("doc_id", "outcome")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def cardinality_check(t):
    return validate.repeated_keys(t("orders"), "o_custkey")


@query("SELECT c_custkey, o_orderkey, l_linenumber FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey")
def owner_documents_messages(t):
    return catalog.owner_chain(t("customer"), t("orders"), t("lineitem"), "c_custkey", "o_custkey", "o_orderkey", "l_orderkey").select("c_custkey", "o_orderkey", "l_linenumber")


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)")
def optional_parent(t):
    return catalog.optional_parent(t("documents").select("doc_id"), t("labels"), "doc_id").select("doc_id", "quality")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_objects(t):
    return integrity.orphans(t("documents").select("doc_id"), t("labels"), "doc_id")


@query("SELECT 'left' AS part, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id * 2 FROM labels) UNION ALL SELECT DISTINCT 'missing', doc_id * 2 FROM labels WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents)")
def delete_with_missing(t):
    left, missing = mutate.delete_keys(t("documents").select("doc_id"), t("labels").select((c("doc_id") * 2).alias("doc_id")), "doc_id")
    return left.select(lit("left").alias("part"), "doc_id").unionByName(missing.select(lit("missing").alias("part"), "doc_id"))


@query("WITH o AS (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'MACHINERY') SELECT 'orders' AS part, count(*) AS n FROM o UNION ALL SELECT 'lines', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)")
def cascade_delete(t):
    gone = t("customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey")
    _, orders, lines = mutate.cascade_delete(t("customer"), gone, [(t("orders"), "o_orderkey", "o_custkey"), (t("lineitem"), "l_linenumber", "l_orderkey")], "c_custkey")
    count = lambda rows, part: rows.agg(lit(part).alias("part"), F.count(lit(1)).alias("n"))
    return count(orders, "orders").unionByName(count(lines, "lines"))


@query("SELECT o_orderkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE o_custkey END AS o_custkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def set_null_delete(t):
    gone = t("customer").where("c_mktsegment = 'MACHINERY'").select(c("c_custkey").alias("o_custkey"))
    return mutate.set_null(t("orders").select("o_orderkey", "o_custkey"), gone, "o_custkey")


@query("SELECT p_name AS key, count(*) AS n, string_agg(p_partkey::VARCHAR, ', ' ORDER BY p_partkey::VARCHAR) AS members FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(t):
    return integrity.duplicate_groups(t("part"), c("p_name"), c("p_partkey").cast("string"))


@query("SELECT conv_id, count(*) FILTER (turn = 0) AS roots, count(*) FILTER (NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = e.conv_id AND d.turn = e.turn + 1)) AS heads, count(*) FILTER (turn = 0) = 1 AND count(*) FILTER (NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = e.conv_id AND d.turn = e.turn + 1)) = 1 AS sound FROM conversations e GROUP BY conv_id")
def chain_integrity(t):
    return integrity.chain_integrity(t("conversations").select("conv_id", "turn", F.when(c("turn") > 0, c("turn") - 1).alias("parent")), "conv_id", "turn", "parent")


@query("SELECT n_name AS name FROM nation EXCEPT SELECT r_name FROM region")
def missing_names(t):
    return integrity.missing_names(t("nation").select(c("n_name").alias("name")), t("region").select("r_name"))


@query("SELECT conv_id, count(*) AS turns, sha256(string_agg(turn || ':' || role, ',' ORDER BY turn)) AS listed FROM conversations GROUP BY 1")
def nested_children(t):
    rows = catalog.nested_children(t("conversations"), "conv_id", "turn", "role")
    own = F.from_json("children", "array<struct<turn:bigint,role:string>>")
    listed = F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["turn"].cast("string"), x["role"])), ",")
    return rows.select("conv_id", F.size(own).cast("long").alias("turns"), F.sha2(listed, 256).alias("listed"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'ready' WHEN 'P' THEN 'processing' END AS label, o_orderstatus = 'F' AS may_chat FROM orders")
def status_dimension(t):
    return catalog.status_labels(t("orders"), "o_orderstatus", {"O": "open", "F": "ready", "P": "processing"}, "F").select("o_orderkey", "label", "may_chat")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'unknown' ELSE c_name END AS name FROM customer")
def blank_default(t):
    return t("customer").select("c_custkey", fn.blank_default(F.when(c("c_custkey") % 3 == 0, lit(" \t ")).otherwise(c("c_name")), "unknown").alias("name"))


@query("SELECT p_partkey, coalesce(upper(array_to_string(list_transform(string_split(p_name, ' '), lambda w: w[1:1]), '')[1:2]), 'US') AS initials FROM part")
def initials(t):
    return t("part").select("p_partkey", fn.initials(c("p_name")).alias("initials"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day FROM orders")
def local_date(t):
    return t("orders").select("o_orderkey", fn.local_date(c("o_orderdate")).alias("day"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS at FROM events")
def iso_time(t):
    return t("events").select("event_id", fn.iso_time(c("ts")).alias("at"))


@query(f"SELECT c_custkey, trim(lower(chr(9) || c_name || chr(160)), {_W}) AS key FROM customer")
def normalise_key(t):
    return t("customer").select("c_custkey", fn.normalise_key(F.concat(lit("\t"), c("c_name"), lit("\xa0"))).alias("key"))


@query("""SELECT '{"event_id":' || event_id || ',"event":"' || event_type || '","app_version":"1.0","environment":"test"}' AS value FROM events""")
def log_to_json(t):
    return t("events").select(F.to_json(F.struct("event_id", c("event_type").alias("event"), lit("1.0").alias("app_version"), lit("test").alias("environment"))).alias("value"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bound FROM events")
def context_log(t):
    return ordered.carried(t("events").withColumn("bound", F.when(c("event_type") == "signup", c("event_id"))), "user_id", ["ts", "event_id"], "bound").select("event_id", "bound")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) <= 5 AS allowed FROM events")
def rate_limited(t):
    return rate_limit(t("events"), ["user_id"], "ts", "event_id", "1 day").select("event_id", "allowed")


def _streamed(name: str, make: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """Register a query that lets the table ``events`` arrive as a stream, runs ``make`` of it to its end and returns what was written."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        table, path = read_table(spark, folder, "events"), f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        table.write.parquet(f"{path}/arrived")
        made = make(spark.readStream.schema(table.schema).parquet(f"{path}/arrived"))
        append_stream(made, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
        return spark.read.schema(made.schema).parquet(f"{path}/rows")

    QUERIES[name], ORACLES[name] = run, sql


_streamed("rate_limited_stream", lambda x: rate_limit_stream(x.select("event_id", "user_id", "ts"), ["user_id"], "ts", "event_id", "1 day", parts=PARTS).select("event_id", "allowed"), ORACLES["rate_limited"])
_streamed(
    "token_use_stream",
    lambda x: token_use_stream(x.select("event_id", F.concat_ws(":", c("user_id").cast("string"), "event_type").alias("token"), "ts", (c("event_type") == "error").alias("revoked"), _now().alias("expires_at")), "token", "ts", "event_id", "revoked", "expires_at").select("event_id", "token", "won"),
    ORACLES["single_use_consume"],
)


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS place FROM events")
def numbered_events(t):
    return ordered.numbered(t("events").select("ts", "event_id"), ["ts", "event_id"]).select("event_id", "place")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'bad ' || event_type ELSE 'failed' END AS message FROM events")
def error_message(t):
    body = F.when(c("event_id") % 3 == 0, F.to_json(F.struct(c("event_type").alias("detail")))).when(
        c("event_id") % 3 == 1, F.to_json(F.struct(F.array(F.struct(F.array(lit("body")).alias("loc"), F.concat(lit("bad "), "event_type").alias("msg"))).alias("detail")))
    ).otherwise(lit("{}"))
    return t("events").select("event_id", fn.error_message(body, "failed").alias("message"))


@query("SELECT event_id, k AS key, coalesce(try_cast(json_extract_string(props, '$.' || k) AS DOUBLE), 0) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def map_explode_report(t):
    each = t("events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return each.select("event_id", "key", F.coalesce(c("value").try_cast("double"), lit(0.0)).alias("value"))


@query("""WITH f AS (SELECT l_shipdate::DATE::VARCHAR AS name, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS missing FROM lineitem GROUP BY 1),
r AS (SELECT 0 AS section, 'TOTAL' AS name, 100.0::DOUBLE * count(*) FILTER (l_returnflag <> 'R') / count(*) AS percent, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS missing FROM lineitem UNION ALL SELECT 1, name, CASE WHEN missing < n THEN 100.0::DOUBLE * (n - missing) / n ELSE 0 END, n, missing FROM f)
SELECT section, (row_number() OVER (ORDER BY section, percent, name) - 1)::INT AS place, '| `' || name || '` | ' || printf('%.1f%%', percent) || ' | ' || n || ' | ' || missing || ' |' AS line FROM r""")
def report_lines(t):
    """A report's lines in order. Items and totals come as rows whose absent numbers are 0; places are given range by range."""
    lines = t("lineitem")
    n, missing = F.count(lit(1)).alias("num_statements"), F.nullif(F.count(F.when(c("l_returnflag") == "R", 1)), lit(0).cast("long")).alias("missing_lines")
    share = F.nullif(100.0 * F.count(F.when(c("l_returnflag") != "R", 1)) / F.count(lit(1)), lit(0.0)).alias("percent_covered")
    files = lines.groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("name")).agg(n, missing, share)
    every = report.report_rows(report.summary_items(lines.agg(n, missing, share).withColumn("name", lit("TOTAL"))), report.summary_items(files))
    placed = ordered.numbered(every, ["section", "percent", "name"])
    return placed.select("section", c("place").cast("int").alias("place"), "line")


@query("SELECT event_id, round(value / 3, 2) AS amount FROM events")
def rounded(t):
    return t("events").select("event_id", fn.rounded(c("value") / 3).alias("amount"))


@query("SELECT p_partkey, printf('%.1f%%', p_size * 100 / 57.0) AS share FROM part")
def percent(t):
    return t("part").select("p_partkey", fn.percent(c("p_size") * 100 / lit(57.0)).alias("share"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_acctbal >= 0 THEN c_mktsegment END, 'user') AS role, 0::BIGINT AS nulls_left FROM customer")
def add_column_backfill(t):
    """The nulls that are left are counted by the pass that writes the new version."""
    rows = mutate.backfill(t("customer").select("c_custkey", F.when(c("c_acctbal") >= 0, c("c_mktsegment")).alias("role")), "role", lit("user"))
    path = f"{shared_folder(rows.sparkSession)}/backfill-{uuid.uuid4().hex}"
    told = checked.write_checked(rows, path, required=["role"])
    return rows.sparkSession.read.schema(rows.schema).parquet(path).withColumn("nulls_left", lit(told["nulls:role"]).cast("long"))


@query("SELECT s_suppkey AS id, s_name AS name, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def schema_union(t):
    one = t("supplier").select(c("s_suppkey").alias("id"), c("s_name").alias("name"))
    return mutate.append_rows(one, t("customer").select(c("c_custkey").alias("id"), c("c_name").alias("name"), c("c_mktsegment").alias("segment")))


@query("SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation")
def append_rows(t):
    return mutate.append_rows(t("region").select(c("r_name").alias("name")), t("nation").select(c("n_name").alias("name")))


@query(f"SELECT c_custkey AS user_id, c_name AS drug_name, 'pending' AS status, '{NOW}' AS created_at FROM customer")
def catalog_insert_defaults(t):
    rows = t("customer").select(c("c_custkey").alias("user_id"), c("c_name").alias("drug_name"))
    return catalog.with_defaults(rows, {"status": lit("pending"), "created_at": lit(NOW)})


@query("SELECT doc_id, strip_accents(text) AS plain FROM documents")
def unaccent_text(t):
    return t("documents").select("doc_id", fn.unaccent(c("text")).alias("plain"))


_STOP = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in fn.STOP_WORDS.items())


@query(f"SELECT doc_id, len(found)::BIGINT AS n, sha256(array_to_string(list_sort(found), ' ')) AS tokens_sha256 FROM (SELECT doc_id, list_distinct(list_filter(w, lambda x: x <> '' AND NOT list_contains(stop, x))) AS found FROM (SELECT doc_id, string_split_regex(strip_accents(lower(text)), '[^a-z0-9]+') AS w, CASE lang {_STOP} ELSE [] END AS stop FROM documents))")
def text_tokens(t):
    found = t("documents").select("doc_id", fn.text_tokens(c("text"), c("lang")).alias("w"))
    return found.select("doc_id", F.size("w").cast("long").alias("n"), F.sha2(F.array_join(F.array_sort("w"), " "), 256).alias("tokens_sha256"))


_DENSE = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
d AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id)::INT AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(v.e, q.e) AS score FROM v, v q WHERE q.vec_id % {0} = 0))"""


@query(f"WITH {_DENSE.format(20)} SELECT query_id, vec_id, round(score, 4) AS score, rank FROM d WHERE rank <= 10")
def dense_topk(t):
    queries = t("embeddings").where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return retrieval.dense_topk(t("embeddings"), queries, 10).withColumn("score", F.round("score", 4))


_TERMS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '')"
_BM25 = f"""s AS (SELECT doc_id, {_TERMS} AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM s),
a AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark), tf AS (SELECT doc_id, size, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM s) WHERE term IN (SELECT term FROM a) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), r AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score FROM tf JOIN df USING (term) JOIN a USING (term), st GROUP BY 1, 2),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id)::INT AS rank FROM r)"""


@query(f"WITH {_BM25} SELECT item_id, doc_id, round(score, 4) AS score, rank FROM k WHERE rank <= 10")
def bm25_topk(t):
    return retrieval.bm25_topk(t("documents"), t("benchmark"), 10).withColumn("score", F.round("score", 4))


@query(f"WITH s AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df FROM s GROUP BY 1")
def index_terms(t):
    return inverted_index.build_index(t("documents")).terms.select("term", "df")


@query(f"""WITH {_BM25}, v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), d AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id)::INT AS rank FROM (SELECT item_id, v.vec_id AS doc_id, list_cosine_similarity(v.e, q.e) AS score FROM v, v q JOIN benchmark ON item_id = q.vec_id)),
f AS (SELECT item_id, doc_id, coalesce(1 / (60 + x.rank), 0) + coalesce(1 / (60 + y.rank), 0) AS score FROM k x FULL JOIN d y USING (item_id, doc_id)) SELECT item_id, doc_id, rank FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id)::INT AS rank FROM f) WHERE rank <= 10""")
def hybrid_rrf(t):
    """Documents have the vector of their number, questions that of theirs."""
    vectors = t("embeddings").select(c("vec_id").alias("doc_id"), "embedding")
    asked = t("benchmark").select("item_id").join(vectors.withColumnRenamed("doc_id", "item_id"), "item_id")
    sparse = retrieval.bm25_scores(t("documents"), t("benchmark"))
    dense = vector_cells.vector_blocks(vectors, asked, "doc_id", "item_id")
    return retrieval.fused_topk(sparse, dense, 10).select(c("q").alias("item_id"), c("doc").alias("doc_id"), "rank")
