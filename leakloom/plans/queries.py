"""The registered queries of the scanner's own operators, each with DuckDB SQL where SQL can say it.

Test tables hold few kinds of secrets, so the texts of a query get one derived from the document's id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import findings, plausible
from ..operators import accepted, grams, registry, state
from ..operators.detect import detect, documents_as_sources, encoded_runs, example, keyword_documents, matches, spread
from ..sources import archives, files, hosting, joblog, ranges, sinks, stores, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rule(detector_id: str) -> registry.Detector:
    return next(d for d in registry.load() if d.id == detector_id)


def _matches(texts: DataFrame, detector_id: str) -> DataFrame:
    """(doc_id, secret) of all matches of a detector of the registry."""
    return matches(texts, (_rule(detector_id),)).select("doc_id", "secret")


def _sql_pattern(detector_id: str) -> str:
    """A detector's pattern as the inside of a SQL string; group 1 is what precedes the secret, group 2 the secret."""
    return _rule(detector_id).linear[0].replace("'", "''")


def _from(text: str, detector_id: str) -> str:
    return f"SELECT doc_id, unnest(regexp_extract_all({text}, '{_sql_pattern(detector_id)}', 2)) AS secret FROM documents"


ASSIGNED, TOKEN, URI, PEM, LINE, BROAD = "generic-assigned-secret", "github-token", "postgres-uri", "private-key", "datadog-api-key", "bamboohr-api-key"


def _with(docs: DataFrame, *parts: Column | str) -> DataFrame:
    return docs.select("doc_id", F.concat("text", *[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("text"))


def _id(mod: int | None = None) -> Column:
    return F.md5((F.col("doc_id") % mod if mod else F.col("doc_id")).cast("string"))


_TOKEN_SQL = _from("text || ' ghp_' || md5((doc_id % 97)::VARCHAR) || 'abcd '", TOKEN)


@query(_from("text", ASSIGNED))
def detect_assigned_secret(spark, sf_dir):
    return _matches(_table(spark, sf_dir, "documents"), ASSIGNED)


@query(_TOKEN_SQL)
def detect_prefix_tokens(spark, sf_dir):
    return _matches(_with(_table(spark, sf_dir, "documents"), " ghp_", _id(97), "abcd "), TOKEN)


@query("SELECT doc_id, secret FROM (" + _from("text || CASE WHEN doc_id % 3 = 0 THEN ' ghp_' || md5((doc_id % 97)::VARCHAR) || 'abcd ' ELSE '' END", TOKEN) + ")")
def gram_rescan(spark, sf_dir):
    """A detector run on the candidates of the corpus's index of grams alone."""
    docs = _with(_table(spark, sf_dir, "documents"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" ghp_"), _id(97), F.lit("abcd "))).otherwise(""))
    sources = spread(documents_as_sources(docs))
    found = grams.rescan(sources, tables.written(grams.index(sources), "grams"), (_rule(TOKEN),))
    return found.select(F.substring_index("file", "/", -1).cast("long").alias("doc_id"), "secret")


@query(_from("text || ' postgres://app:' || md5(doc_id::VARCHAR) || '@db.example.com/x '", URI))
def detect_uri_credentials(spark, sf_dir):
    return _matches(_with(_table(spark, sf_dir, "documents"), " postgres://app:", _id(), "@db.example.com/x "), URI)


@query(_from("text || chr(10) || '-----BEGIN RSA PRIVATE KEY-----' || chr(10) || md5(doc_id::VARCHAR) || chr(10) || '-----END RSA PRIVATE KEY-----'", PEM))
def detect_pem(spark, sf_dir):
    return _matches(_with(_table(spark, sf_dir, "documents"), "\n-----BEGIN RSA PRIVATE KEY-----\n", _id(), "\n-----END RSA PRIVATE KEY-----"), PEM)


@query(_from("text || ' datadog_key = \"' || md5(doc_id::VARCHAR) || '\" '", LINE))
def detect_line_context(spark, sf_dir):
    return _matches(_with(_table(spark, sf_dir, "documents"), ' datadog_key = "', _id(), '" '), LINE)


_BROAD_TEXT = "text || ' bamboohr.com ' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || ' ' || chr(10) ELSE chr(10) END || 'api_key: ' || md5(doc_id::VARCHAR) || ' '"


@query(f"SELECT doc_id, secret FROM (SELECT doc_id, unnest(regexp_extract_all({_BROAD_TEXT}, '{_sql_pattern(BROAD)}', 1)) AS before, unnest(regexp_extract_all({_BROAD_TEXT}, '{_sql_pattern(BROAD)}', 2)) AS secret FROM documents) WHERE NOT regexp_matches(before, '\\n[ \\t\\r]*\\n')")
def detect_broad_context(spark, sf_dir):
    gap = F.when(F.col("doc_id") % 2 == 0, F.lit("\n \n")).otherwise(F.lit("\n"))
    texts = _with(_table(spark, sf_dir, "documents"), " bamboohr.com ", gap, "api_key: ", _id(), " ")
    found = detect(documents_as_sources(texts), (_rule(BROAD),))
    return found.select(F.substring_index("file", "/", -1).cast("long").alias("doc_id"), "secret")


_PIECES_SQL = "SELECT doc_id, unnest(regexp_extract_all(text || chr(10) || CASE doc_id % 3 WHEN 0 THEN '  ' || chr(10) WHEN 1 THEN 'x' || chr(10) ELSE '' END || 'end.', '[^.]{1,400}[.]', 0)) AS piece FROM documents"


@query(f"SELECT doc_id, length(piece) AS chars FROM ({_PIECES_SQL}) WHERE NOT regexp_matches(piece, '\\n[ \\t\\r]*\\n')")
def blank_line_guard(spark, sf_dir):
    """The pieces between the points of every text that no blank line crosses, as the guard of wide contexts has it."""
    kind = F.col("doc_id") % 3
    texts = _with(_table(spark, sf_dir, "documents"), "\n", F.when(kind == 0, "  \n").when(kind == 1, "x\n").otherwise(""), "end.")
    pieces = texts.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[^.]{1,400}[.]"), F.lit(0))).alias("piece"))
    return pieces.where(~plausible.blank_line(F.col("piece"))).select("doc_id", F.length("piece").cast("long").alias("chars"))


def _registered(f: Callable[[], str]):
    """Registers a query whose SQL is made from the table of detectors; without the table it has none."""
    return query(f() if registry.DEFAULT_TABLE.exists() else None)


def _keywords_sql() -> str:
    words = sorted({k for d in registry.load() for k in d.usable_keywords})
    return "SELECT keyword, count(*) AS documents FROM documents, (SELECT unnest([" + ", ".join("'" + k.replace("'", "''") + "'" for k in words) + "]) AS keyword) WHERE contains(lower(text), keyword) GROUP BY keyword"


@_registered(_keywords_sql)
def keyword_prefilter(spark, sf_dir):
    """How many documents the prefilter passes on for each keyword of the registry."""
    return keyword_documents(_table(spark, sf_dir, "documents"), registry.load())


_GAPS_SQL = f"""SELECT doc_id, generate_subscripts(whole, 1) AS k, gaps, whole, head FROM (
  SELECT doc_id, regexp_extract_all(text, '{_sql_pattern(ASSIGNED)}', 0) AS whole, regexp_extract_all(text, '{_sql_pattern(ASSIGNED)}', 1) AS head, regexp_split_to_array(text, '{_sql_pattern(ASSIGNED)}') AS gaps FROM documents WHERE regexp_matches(text, '{_sql_pattern(ASSIGNED)}'))"""


@query(f"""WITH before AS (SELECT doc_id, gaps[1] || array_to_string(list_transform(range(2, k + 1), lambda i: whole[i - 1] || gaps[i]), '') || head[k] AS b FROM ({_GAPS_SQL}))
SELECT doc_id, 1 + strlen(b) - strlen(replace(b, chr(10), '')) AS line, strlen(split_part(b, chr(10), -1)) + 1 AS column FROM before""")
def finding_location(spark, sf_dir):
    """Line and column of every match's secret."""
    return matches(_table(spark, sf_dir, "documents"), (_rule(ASSIGNED),)).select("doc_id", "line", "column")


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of derived tokens and of assigned secrets."""
    docs = _table(spark, sf_dir, "documents")
    tokens = detect_prefix_tokens(spark, sf_dir).withColumn("detector_id", F.lit("github-token")).withColumn("severity", F.lit("critical"))
    assigned = _matches(docs, ASSIGNED).withColumn("detector_id", F.lit(ASSIGNED)).withColumn("severity", F.lit("medium"))
    rows = tokens.unionByName(assigned).withColumn("file", F.concat(F.lit("documents/"), (F.col("doc_id") % 50).cast("string"))).withColumn("commit", F.lit(""))
    return rows.withColumn("fingerprint", findings.fingerprint(F.col("detector_id"), F.col("secret"), F.col("file"), F.col("commit")))


_FOUND_SQL = f"""found AS (
  SELECT *, sha256(detector_id || chr(0) || secret || chr(0) || file || chr(0) || "commit") AS fingerprint FROM (
    SELECT doc_id, secret, 'github-token' AS detector_id, 'critical' AS severity, 'documents/' || (doc_id % 50) AS file, '' AS "commit" FROM ({_TOKEN_SQL})
    UNION ALL SELECT doc_id, secret, 'generic-assigned-secret', 'medium', 'documents/' || (doc_id % 50), '' FROM ({_from("text", ASSIGNED)})))"""


@query(f"WITH {_FOUND_SQL} SELECT doc_id, detector_id, fingerprint FROM found")
def fingerprints(spark, sf_dir):
    return _found(spark, sf_dir).select("doc_id", "detector_id", "fingerprint")


@query(f"WITH {_FOUND_SQL}, s AS (SELECT doc_id, unnest([secret, left(secret, 4 + (doc_id % 20)::INT)]) AS s FROM found) SELECT doc_id, CASE WHEN strlen(s) <= 8 THEN repeat('*', strlen(s)) ELSE left(s, 4) || repeat('*', strlen(s) - 8) || right(s, 4) END AS redacted FROM s")
def redacted(spark, sf_dir):
    """Whole secrets, and beginnings of 4 to 23 characters besides."""
    rows = _found(spark, sf_dir).select("doc_id", F.explode(F.array("secret", F.expr("left(secret, 4 + cast(doc_id % 20 as int))"))).alias("s"))
    return rows.select("doc_id", findings.redacted(F.col("s")).alias("redacted"))


CASES = ("${DB_PASSWORD}", "$DB_PASSWORD", "{{ vault_token }}", "$(get-secret)", "%API_KEY%", "!API_KEY!", "os.getenv('TOKEN')", "process.env.SECRET", "vault://kv/app", "ENC[AES256,abc]", "config.api_key", "settings.secret_token", "API_KEY", "my_secret", "mySecretValue", "other.api_key", "A1b2C3d4E5f6G7h8", "xxxxxxxxxxxx", "00000000", "short", "[^a-z]secret", "(?:token)abcd", "ref+vault://x/y", "$[secret]", "secret_aaaaaaaaaaaaaaaaaaaaaaaaa")


#: What the filters are asked about in the texts: words with a sign of a reference.
_WORDS = r"[A-Za-z0-9_.$%!{}()-]*[_$%!{][A-Za-z0-9_.$%!{}()-]+"


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, value): such words of all texts, and for each document one of ``CASES`` or a hash."""
    docs = _table(spark, sf_dir, "documents")
    own = F.element_at(F.array(*map(F.lit, CASES)), (F.col("doc_id") % len(CASES) + 1).cast("int"))
    planted = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, _id()).otherwise(own).alias("value"))
    return planted.unionByName(docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_WORDS), F.lit(0))).alias("value")))


_LIST = ", ".join("'" + c.replace("'", "''") + "'" for c in CASES)
_CASES_SQL = f"cases AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN md5(doc_id::VARCHAR) ELSE list_extract([{_LIST}], (doc_id % {len(CASES)} + 1)::INT) END AS value FROM documents UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '{_WORDS}', 0)) FROM documents)"
_NAME = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*"
_ACCESS = "|".join(a.replace(".", r"\.") for a in plausible.ACCESSORS)
_WRAPPED_SQL = rf"^(?:\$\{{[\s\S]*\}}|%\{{[\s\S]*\}}|\{{\{{[\s\S]*\}}\}}|\$\([\s\S]*\)|\$\[[\s\S]*\]|%{_NAME}%|!{_NAME}!|(?i:enc)\[[\s\S]*\]|(?i:(?:ref\+)?vault)://[\s\S]*|\${_NAME}|(?i:{_ACCESS})[\t\n\f\r ]*[.\[(][\s\S]*)$"
_TERM_SQL = "|".join(plausible.TERMS)
_ROOT_SQL = ", ".join(f"'{r}'" for r in plausible.ROOTS)
_REFERENCE_SQL = f"""(regexp_matches(value, '{_WRAPPED_SQL}') OR (regexp_matches(value, '^{_NAME}$') AND regexp_matches(lower(value), '{_TERM_SQL}')
  AND CASE WHEN contains(value, '.') THEN lower(split_part(regexp_replace(value, '^_', ''), '.', 1)) IN ({_ROOT_SQL}) AND list_max([length(p) for p in regexp_split_to_array(value, '[._]')]) < 32
  ELSE (contains(value, '_') OR value = upper(value)) AND list_max([length(p) for p in regexp_split_to_array(value, '[._]')]) < 12 END))"""


@query(f"WITH {_CASES_SQL} SELECT doc_id, {_REFERENCE_SQL} AS reference FROM cases")
def variable_reference_filter(spark, sf_dir):
    return _cases(spark, sf_dir).select("doc_id", plausible.reference(F.col("value")).alias("reference"))


@query(f"WITH {_CASES_SQL} SELECT doc_id, value FROM cases WHERE strlen(value) >= 8 AND NOT regexp_matches(value, '^(?:0+|x+)$') AND NOT {_REFERENCE_SQL} AND NOT (contains(value, '[^') OR contains(value, '\\s') OR contains(value, '\\w') OR contains(value, '(?:') OR contains(value, '(?i)'))")
def plausibility_filter(spark, sf_dir):
    return _cases(spark, sf_dir).where(plausible.plausible(F.col("value")))


_KEYS_SQL = "|".join(sorted(plausible.KEYS, key=len, reverse=True))
_PLACE_TEXT = "'Server=db;' || list_extract(['Password', 'api-key', 'clientsecret', 'Pass'], (doc_id % 4 + 1)::INT) || ' = ' || CASE WHEN doc_id % 2 = 0 THEN '${DB}' WHEN doc_id % 3 = 0 THEN '\"API_KEY\"' ELSE md5(doc_id::VARCHAR) END || ';x'"


@query(rf"""WITH t AS (SELECT doc_id, regexp_extract_all({_PLACE_TEXT}, '(?i)(?:^|[;\s])(?:{_KEYS_SQL})\s*=\s*("[^"]*"|[^;\s]+)', 1) AS v FROM documents)
SELECT doc_id, coalesce(list_bool_or([regexp_matches(x, '^\$\{{') OR x = '"API_KEY"' for x in v]), false) AS placeholder FROM t""")
def placeholder_filter(spark, sf_dir):
    key = F.element_at(F.array(*map(F.lit, ("Password", "api-key", "clientsecret", "Pass"))), (F.col("doc_id") % 4 + 1).cast("int"))
    value = F.when(F.col("doc_id") % 2 == 0, F.lit("${DB}")).when(F.col("doc_id") % 3 == 0, F.lit('"API_KEY"')).otherwise(_id())
    text = F.concat(F.lit("Server=db;"), key, F.lit(" = "), value, F.lit(";x"))
    return _table(spark, sf_dir, "documents").select("doc_id", plausible.placeholder(text).alias("placeholder"))


_B64_TEXT = "'blob=' || rtrim(to_base64(encode('token = \"' || md5(doc_id::VARCHAR) || '\"')), '=') || ' ' || text"
_B64_OK = "length(rtrim(run, '=')) % 4 <> 1 AND length(run) <= 8192 AND NOT (regexp_matches(run, '[-_]') AND regexp_matches(run, '[+/]'))"


def _encoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.regexp_replace(F.base64(F.encode(F.concat(F.lit('token = "'), _id(), F.lit('"')), "UTF-8")), r"[\r\n=]", "")
    return _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("blob="), payload, F.lit(" "), "text").alias("text"))


@query(f"SELECT doc_id, run FROM (SELECT doc_id, unnest(regexp_extract_all({_B64_TEXT}, '\\b([A-Za-z0-9+/_-]{{20,}}={{0,2}})\\b', 1)) AS run FROM documents) WHERE {_B64_OK}")
def base64_candidates(spark, sf_dir):
    return encoded_runs(_encoded_texts(spark, sf_dir))


@query()
def base64_decoded_findings(spark, sf_dir):
    """What the whole registry finds in the payloads of all base64 runs of all documents, and where. Tested against plain Python."""
    found = detect(documents_as_sources(_encoded_texts(spark, sf_dir))).where("view = 1")
    return found.select(F.substring_index("file", "/", -1).cast("long").alias("doc_id"), "detector_id", "secret", "line", "column")


def _examples() -> list[tuple[str, str, str]]:
    """(detector, text, secret): an example of each detector's own shape."""
    return [(d.id, *example(d)) for d in registry.load()]


def _quoted(value: str) -> str:
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in value.split("\n"))


def _every_sql() -> str:
    rows = ", ".join(f"({k}, '{i}', {_quoted(secret)})" for k, (i, _, secret) in enumerate(_examples()))
    n = len(registry.load())
    return f"WITH e(k, detector_id, secret) AS (VALUES {rows}) SELECT doc_id, detector_id, secret FROM documents JOIN e ON k IN ((2 * doc_id) % {n}, (2 * doc_id + 1) % {n})"


@_registered(_every_sql)
def detect_every_detector(spark, sf_dir):
    """Each document twice, with an example of another detector behind it, through the whole registry: those must be found."""
    own = _examples()
    table = spark.createDataFrame([(k, i, text, secret) for k, (i, text, secret) in enumerate(own)], "k long, detector_id string, example string, secret string")
    docs = spread(_table(spark, sf_dir, "documents")).select("doc_id", "text", F.explode(F.array(*((2 * F.col("doc_id") + j) % len(own) for j in (0, 1)))).alias("k"))
    planted = docs.join(F.broadcast(table), "k").select(F.concat_ws("/", "doc_id", "k").alias("id"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n "), "example").alias("text"))
    parts = F.split("file", "/")
    found = detect(documents_as_sources(planted, "id")).select(parts[1].cast("long").alias("doc_id"), parts[2].cast("long").alias("k"), "detector_id", "secret")
    return found.join(F.broadcast(table), ["k", "detector_id", "secret"]).select("doc_id", "detector_id", "secret")


@query(f'WITH {_FOUND_SQL} SELECT detector_id, secret, file, min(doc_id) AS start FROM found GROUP BY detector_id, secret, file, "commit"')
def dedupe_first(spark, sf_dir):
    rows = _found(spark, sf_dir).withColumn("view", F.lit(0)).withColumnRenamed("doc_id", "start")
    return findings.first_in_file(rows).select("detector_id", "secret", "file", "start")


@query(f"WITH {_FOUND_SQL} SELECT DISTINCT fingerprint FROM found")
def dedupe_fingerprint(spark, sf_dir):
    return findings.distinct(_found(spark, sf_dir)).select("fingerprint")


@query(f"WITH {_FOUND_SQL} SELECT doc_id, fingerprint FROM found WHERE fingerprint NOT IN (SELECT fingerprint FROM found WHERE doc_id % 3 = 0)")
def baseline_filter(spark, sf_dir):
    found = _found(spark, sf_dir).select("doc_id", "fingerprint")
    return state.without_baseline(found, found.where("doc_id % 3 = 0"))


@query(f"WITH {_FOUND_SQL} SELECT doc_id, fingerprint FROM found WHERE fingerprint NOT IN (SELECT fingerprint FROM found WHERE doc_id % 3 = 0)")
def baseline_index(spark, sf_dir):
    """The same by an index that is written and loaded: blocks of bits first, then the bucketed table."""
    found = _found(spark, sf_dir).select("doc_id", "fingerprint")
    folder = tables.fresh(spark, "accepted-index")
    accepted.write(found.where("doc_id % 3 = 0"), folder)
    return accepted.without(found, accepted.load(folder))


@query(f"WITH {_FOUND_SQL} SELECT DISTINCT fingerprint FROM found WHERE fingerprint <> '' ORDER BY 1")
def baseline_fingerprints(spark, sf_dir):
    return state.baseline_of(_found(spark, sf_dir))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.array(*map(F.lit, (".txt", ".PNG", ".png", ".tar.gz", ".zip", ".env", ".md", ".tgz", ".gz", ".tar")))
    path = F.concat(F.lit("site/"), F.regexp_replace("url", r"^https?://|[?#].*$", ""), F.element_at(ends, (F.col("page_id") % 10 + 1).cast("int")))
    return _table(spark, sf_dir, "pages").select("page_id", path.alias("path"))


_PATHS_SQL = "paths AS (SELECT page_id, 'site/' || regexp_replace(url, '^https?://|[?#].*$', '', 'g') || list_extract(['.txt', '.PNG', '.png', '.tar.gz', '.zip', '.env', '.md', '.tgz', '.gz', '.tar'], (page_id % 10 + 1)::INT) AS path FROM pages)"


@query(f"WITH {_PATHS_SQL} SELECT page_id, path FROM paths WHERE NOT regexp_matches(split_part(path, '/', -1), '\\.(?:png|jpg|jpeg|gif|webp|ico|pdf|7z|exe|dll|so|dylib|zip|tar|gz|tgz)$') AND NOT regexp_matches(split_part(path, '/', -1), '^[^/]*5\\.[^/]*$')")
def path_filter(spark, sf_dir):
    return _paths(spark, sf_dir).where(files.allowed(F.col("path"), exclude=["*5.*"]))


@query(f"WITH {_PATHS_SQL} SELECT page_id, CASE WHEN lower(path) LIKE '%.zip' THEN 'zip' WHEN lower(path) LIKE '%.tar.gz' OR lower(path) LIKE '%.tgz' THEN 'targz' WHEN lower(path) LIKE '%.tar' THEN 'tar' WHEN lower(path) LIKE '%.gz' THEN 'gz' ELSE '' END AS kind FROM paths")
def archive_kind(spark, sf_dir):
    return _paths(spark, sf_dir).select("page_id", files.archive_kind(F.col("path")).alias("kind"))


@query("SELECT doc_id, (doc_id % 5 = 0 AND strlen(text) < 8000) AS is_binary FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def binary_filter(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    content = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("\x00"))).otherwise(F.col("text")).cast("binary")
    return docs.select("doc_id", files.is_binary(content).alias("is_binary"))


@query("""WITH e AS (SELECT l_orderkey AS archive, l_linenumber AS idx, (l_quantity * 10)::BIGINT AS size FROM lineitem WHERE l_quantity * 10 <= 450),
r AS (SELECT *, sum(size) OVER w AS total, count(*) OVER w AS place FROM e WINDOW w AS (PARTITION BY archive ORDER BY idx, size ROWS UNBOUNDED PRECEDING))
SELECT archive, idx, size FROM r WHERE total <= 900 AND place <= 4""")
def archive_budget(spark, sf_dir):
    entries = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("archive"), F.col("l_linenumber").alias("idx"), (F.col("l_quantity") * 10).cast("long").alias("size"))
    return state.within_budget(entries, 4, 900, 450).select("archive", "idx", "size")


@query("""WITH objects AS (SELECT p_partkey AS oid, md5(p_name) AS secret FROM part),
places AS (SELECT DISTINCT l_partkey AS oid, l_orderkey AS "commit", l_suppkey AS path FROM lineitem)
SELECT oid, "commit", 'dir/' || path || CASE WHEN oid % 3 = 0 THEN '!/in/' || oid || '.env' ELSE '' END AS file, sha256('d' || chr(0) || secret || chr(0) || file || chr(0) || "commit") AS fingerprint FROM objects JOIN places USING (oid)""")
def history_fanout(spark, sf_dir):
    """Every object's finding at every (commit, path) of it, an archive entry's suffix kept, by ``reidentify``."""
    suffix = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("!/in/"), F.col("p_partkey").cast("string"), F.lit(".env"))).otherwise(F.lit(""))
    objects = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("oid"), F.lit("d").alias("detector_id"), F.md5("p_name").alias("secret"), F.concat(F.lit("x"), suffix).alias("file"), F.lit("").alias("commit"), F.lit("").alias("fingerprint"))
    lines = _table(spark, sf_dir, "lineitem")
    places = lines.select(F.col("l_partkey").alias("oid"), F.col("l_orderkey").cast("string").alias("commit"), F.concat(F.lit("dir/"), F.col("l_suppkey").cast("string")).alias("path")).distinct()
    return findings.reidentify(objects, places).select("oid", F.col("commit").cast("long").alias("commit"), "file", "fingerprint")


def _transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("pending")
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("target"), status.alias("status"), F.lit("").alias("error"), F.struct("ts", "event_id").alias("at"))


_STATE_SQL = """t AS (SELECT user_id AS target, event_id, ts, CASE event_type WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'pending' END AS status FROM events),
state AS (SELECT target, arg_max(status, (ts, event_id)) AS status, count(*) FILTER (status = 'running') AS attempts FROM t GROUP BY target)"""


@query(f"WITH {_STATE_SQL} SELECT target, status, attempts FROM state")
def job_latest_state(spark, sf_dir):
    return state.latest(_transitions(spark, sf_dir)).select("target", "status", "attempts")


@query("WITH t AS (SELECT user_id AS target, ts, CASE event_type WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'pending' END AS status FROM events) SELECT target, arg_max(status, (ts, status)) AS status, count(*) FILTER (status = 'running') AS attempts FROM t GROUP BY target")
def job_log(spark, sf_dir):
    """The same states of a log: tasks append the transitions as files, which are compacted, and read beside the snapshot that holds them."""
    folder = tables.fresh(spark, "job-log")
    rows = _transitions(spark, sf_dir).select(F.col("target").cast("string").alias("target"), "status", "error", F.unix_micros(F.col("at.ts").cast("timestamp")).alias("at"))
    tables.written(joblog.append_frame(rows.repartition(4), folder, "job"), "job-log-written")
    joblog.compact(spark, folder)
    return joblog.states(spark, folder, "job").select(F.col("target").cast("long").alias("target"), "status", "attempts")


_TARGETS = "targets AS (SELECT c_custkey AS target FROM customer)"


@query(f"WITH {_STATE_SQL}, {_TARGETS} SELECT coalesce(status, 'pending') AS status, count(*) AS targets FROM targets LEFT JOIN state USING (target) GROUP BY 1")
def job_status_counts(spark, sf_dir):
    """Of all targets; those that nothing is known of are pending."""
    targets = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target"))
    return state.status_counts(state.latest(_transitions(spark, sf_dir)), targets)


@query(f"WITH {_STATE_SQL}, {_TARGETS} SELECT target FROM targets LEFT JOIN state USING (target) WHERE coalesce(status, 'pending') <> 'completed'")
def job_resume(spark, sf_dir):
    targets = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target"))
    return state.to_resume(targets, state.latest(_transitions(spark, sf_dir)))


@query(f"WITH {_STATE_SQL}, {_TARGETS} SELECT target FROM targets WHERE target IN (SELECT target FROM state WHERE status = 'failed')")
def job_retry_failed(spark, sf_dir):
    targets = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target"))
    return state.to_retry(targets, state.latest(_transitions(spark, sf_dir)))


@query(f"WITH {_STATE_SQL}, {_TARGETS} SELECT target FROM targets WHERE target NOT IN (SELECT target FROM state)")
def job_add_targets(spark, sf_dir):
    targets = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target"))
    return state.unseen(targets, state.latest(_transitions(spark, sf_dir)))


@query("SELECT source AS owner, count(*) AS repositories FROM documents GROUP BY source")
def owner_rollup(spark, sf_dir):
    names = _table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("full_name"))
    return state.by_owner(names)


@query(f"""WITH {_FOUND_SQL}, r AS (SELECT source AS org, count(*) AS repositories FROM documents GROUP BY 1),
f AS (SELECT source AS org, count(*) AS findings FROM found JOIN documents USING (doc_id) GROUP BY 1)
SELECT org, coalesce(repositories, 0) AS repositories, coalesce(findings, 0) AS findings FROM r FULL JOIN f USING (org)""")
def org_findings(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("org"))
    return state.by_organisation(docs, _found(spark, sf_dir).join(docs, "doc_id"))


_ACCOUNTS = "c AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(n_name) ELSE lower(n_name) END AS account FROM customer JOIN nation ON n_nationkey = c_nationkey), i AS (SELECT n_nationkey AS installation, upper(left(n_name, 1)) || lower(substr(n_name, 2)) AS account FROM nation WHERE n_nationkey % 5 <> 4)"


def _accounts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Installations, and customers with the account they belong to, in another case each."""
    nation = _table(spark, sf_dir, "nation")
    name = F.when(F.col("c_custkey") % 2 == 0, F.upper("n_name")).otherwise(F.lower("n_name"))
    customers = _table(spark, sf_dir, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", name.alias("account"))
    first = F.concat(F.upper(F.substring("n_name", 1, 1)), F.lower(F.expr("substring(n_name, 2)")))
    return nation.where("n_nationkey % 5 <> 4").select(F.col("n_nationkey").alias("installation"), first.alias("account")), customers


@query(f"WITH {_ACCOUNTS} SELECT installation, i.account, count(c_custkey) AS repositories FROM i LEFT JOIN c ON lower(c.account) = lower(i.account) GROUP BY 1, 2")
def installation_rollup(spark, sf_dir):
    return state.by_installation(*_accounts(spark, sf_dir))


@query(f"WITH {_ACCOUNTS} SELECT c_custkey AS target, c.account AS owner, installation FROM c LEFT JOIN i ON lower(c.account) = lower(i.account)")
def target_tokens(spark, sf_dir):
    """The installation whose token reads each target, whatever the case of names; none for some."""
    installations, customers = _accounts(spark, sf_dir)
    return state.with_token(customers.select(F.col("c_custkey").alias("target"), F.col("account").alias("owner")), installations)


@query(f"WITH {_STATE_SQL} SELECT count(*) FILTER (status = 'completed') AS succeeded, count(*) FILTER (status = 'failed') AS failed, array_to_string(list_sort(list(target::VARCHAR) FILTER (status = 'failed')), ',') AS failures FROM state")
def scan_outcomes(spark, sf_dir):
    made = state.outcomes(state.latest(_transitions(spark, sf_dir)).withColumn("target", F.col("target").cast("string")))
    return made.select("succeeded", "failed", F.concat_ws(",", F.array_sort(F.transform("failures", lambda x: x["target"]))).alias("failures"))


@query(f"WITH {_FOUND_SQL} SELECT count(*) AS before, count(*) FILTER (fingerprint NOT IN (SELECT fingerprint FROM found WHERE doc_id % 3 = 0)) AS after FROM found")
def baseline_totals(spark, sf_dir):
    found = _found(spark, sf_dir)
    return state.totals(found, found.where("doc_id % 3 = 0"))


@query("SELECT full_name, arg_max(o_orderkey, o_orderkey) AS idx FROM (SELECT CASE WHEN o_custkey % 7 = 0 THEN ' ' ELSE 'o/' || o_custkey END AS full_name, o_orderkey FROM orders) WHERE trim(full_name) <> '' GROUP BY full_name")
def repo_dedupe_last(spark, sf_dir):
    name = F.when(F.col("o_custkey") % 7 == 0, F.lit(" ")).otherwise(F.concat(F.lit("o/"), F.col("o_custkey").cast("string")))
    return state.last_by_name(_table(spark, sf_dir, "orders").select(name.alias("full_name"), F.col("o_orderkey").alias("idx")), "idx")


@query(f"WITH {_FOUND_SQL} SELECT severity, count(*) AS findings, count(DISTINCT fingerprint) AS distinct_findings FROM found GROUP BY severity")
def severity_rollup(spark, sf_dir):
    return _found(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("findings"), F.countDistinct("fingerprint").alias("distinct_findings"))


@query(f"WITH {_FOUND_SQL} SELECT detector_id, count(DISTINCT secret) AS secrets FROM found GROUP BY detector_id")
def secrets_per_detector(spark, sf_dir):
    return _found(spark, sf_dir).groupBy("detector_id").agg(F.countDistinct("secret").alias("secrets"))


def _reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _found(spark, sf_dir).withColumn("name", F.upper("detector_id")).withColumn("redacted", findings.redacted(F.col("secret")))
    return rows.withColumn("line", F.lit(1)).withColumn("column", F.lit(2))


@query(f"WITH {_FOUND_SQL} SELECT DISTINCT detector_id, upper(detector_id) AS name FROM found")
def sarif_rules_of(spark, sf_dir):
    return sinks.sarif_rules(_reported(spark, sf_dir))


@query(f"WITH {_FOUND_SQL} SELECT detector_id AS rule_id, CASE WHEN severity IN ('critical', 'high') THEN 'error' ELSE 'warning' END AS level, upper(detector_id) || ' ' || left(secret, 4) || repeat('*', strlen(secret) - 8) || right(secret, 4) AS message, file AS uri, 1 AS start_line, 2 AS start_column, fingerprint FROM found")
def sarif_results_of(spark, sf_dir):
    return sinks.sarif_results(_reported(spark, sf_dir))


@query(f"WITH {_FOUND_SQL}, h AS (SELECT *, 'c' || (doc_id % 9) AS c FROM found) SELECT DISTINCT fp FROM (SELECT fingerprint AS fp FROM found UNION ALL SELECT sha256(detector_id || chr(0) || secret || chr(0) || file || chr(0) || c) FROM h)")
def history_union(spark, sf_dir):
    found = _found(spark, sf_dir)
    history = found.withColumn("commit", F.concat(F.lit("c"), (F.col("doc_id") % 9).cast("string")))
    history = history.withColumn("fingerprint", findings.fingerprint(F.col("detector_id"), F.col("secret"), F.col("file"), F.col("commit")))
    return findings.distinct(found.unionByName(history)).select(F.col("fingerprint").alias("fp"))


_SHOWN_SQL = "left(secret, 4) || repeat('*', strlen(secret) - 8) || right(secret, 4)"


@query(f"WITH {_FOUND_SQL} SELECT '[' || severity || '] ' || upper(detector_id) || ' ' || file || ':1:2 ' || {_SHOWN_SQL} AS value FROM found")
def human_report(spark, sf_dir):
    return sinks.human_lines(_reported(spark, sf_dir))


@query(f"""WITH {_FOUND_SQL} SELECT '{{"detector_id":"' || detector_id || '","name":"' || upper(detector_id) || '","severity":"' || severity || '","file":"' || file || '","line":1,"column":2,"secret":"","redacted":"' || {_SHOWN_SQL} || '","verified":false,"fingerprint":"' || fingerprint || '"}}' AS value FROM found""")
def jsonl_report(spark, sf_dir):
    """JSON lines: redacted, an empty commit left out."""
    return sinks.json_lines(_reported(spark, sf_dir).withColumn("verified", F.lit(False)))


@query(f"""WITH {_FOUND_SQL} SELECT detector_id, upper(detector_id) AS name, severity, file, {_SHOWN_SQL} AS redacted, fingerprint FROM found""")
def json_report(spark, sf_dir):
    """A whole report in JSON, joined from the tasks' parts, and read again."""
    from pyspark.sql.types import ArrayType, StructType

    found = _reported(spark, sf_dir).withColumn("verified", F.lit(False))
    path = tables.fresh(spark, "json-report")
    stores.write(path, sinks.report(found, "json"))
    fields = found.select("detector_id", "name", "severity", "file", "redacted", "fingerprint").schema
    whole = spark.read.json(path, multiLine=True, schema=StructType().add("findings", ArrayType(fields)))
    return whole.select(F.explode("findings").alias("f")).select("f.*")


def _catalog_sql() -> str:
    rows = [(c, d.id, "partial" if partial else "implemented") for d in registry.load() for c, _, partial in d.catalog]
    rows += [(c, None, "planned") for c in registry.PLANNED]
    return "m(catalog_id, detector_id, status) AS (VALUES " + ", ".join(f"('{a}', {repr(b) if b else 'NULL'}, '{c}')" for a, b, c in rows) + ")"


def _registry_sql() -> str:
    """The registry's rows again, by a plain reading of the table."""
    severities = {"c": "critical", "h": "high", "m": "medium"}
    rows = []
    for line in registry.DEFAULT_TABLE.read_text(encoding="utf-8").splitlines():
        if line.startswith("|") and line[1:2].isdigit():
            cells = line.split("|")[1:-1]
            words = [w.strip().lower().replace('\\"', '"') for w in cells[8].split(",") if w.strip()]  # the table escapes quotes
            rows.append("('" + "', '".join((cells[1], cells[2].replace("'", "''"), severities[cells[3]])) + f"', [{', '.join("'" + w.replace("'", "''") + "'" for w in words)}], {str('V' in cells[7]).lower()})")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS r(detector_id, name, severity, keywords, verifiable)"


@_registered(lambda: f"WITH {_catalog_sql()} SELECT status, count(*) AS mappings, count(DISTINCT catalog_id) AS catalog_ids, count(DISTINCT detector_id) AS detectors FROM m GROUP BY status")
def parity_status_counts(spark, sf_dir):
    return state.parity_counts(registry.mappings(spark))


@_registered(lambda: f"WITH {_catalog_sql()} SELECT detector_id FROM ({_registry_sql()}) WHERE detector_id NOT IN (SELECT detector_id FROM m WHERE detector_id IS NOT NULL)")
def parity_untracked(spark, sf_dir):
    return state.parity_untracked(registry.frame(spark), registry.mappings(spark))


@_registered(lambda: f"WITH {_catalog_sql()} SELECT catalog_id, count(*) AS mappings FROM m GROUP BY 1 HAVING count(*) > 1")
def parity_duplicates(spark, sf_dir):
    return state.parity_duplicates(registry.mappings(spark))


@_registered(lambda: f"WITH {_catalog_sql()} SELECT catalog_id, detector_id, status FROM m WHERE detector_id IN (SELECT detector_id FROM ({_registry_sql()}))")
def parity_known(spark, sf_dir):
    return state.parity_known(registry.frame(spark), registry.mappings(spark)).select("catalog_id", "detector_id", "status")


@_registered(lambda: f"WITH {_catalog_sql()} SELECT catalog_id, detector_id, status FROM m WHERE catalog_id IN {registry.SUB_DETECTORS}")
def parity_outside(spark, sf_dir):
    return state.parity_outside(registry.catalog(spark), registry.mappings(spark))


@_registered(_registry_sql)
def registry_list(spark, sf_dir):
    return registry.frame(spark)


#: (detector, its secret, the text planted for it) as SQL that both engines read, where {h} is the md5 of a row's key.
_PEM = "'-----BEGIN RSA PRIVATE KEY-----' || chr(10) || {h} || chr(10) || '-----END RSA PRIVATE KEY-----'"
PLANTED = (
    ("github-token", "'ghp_' || {h} || 'abcd'", "' ghp_' || {h} || 'abcd '"),
    ("aws-access-key", "'AKIA' || upper(left({h}, 16))", "' AKIA' || upper(left({h}, 16)) || ' '"),
    ("postgres-uri", "'postgres://app:' || {h} || '@db.example.com/x'", "' postgres://app:' || {h} || '@db.example.com/x '"),
    ("basic-auth-url", "{h}", "''"),
    ("datadog-api-key", "{h}", """' datadog_key = "' || {h} || '" '"""),
    ("private-key", _PEM, f"chr(10) || {_PEM} || chr(10)"),
    ("ssh-private-key", _PEM, "''"),
)


def _planted_sql(key: str, table: str, body: str) -> str:
    own = " UNION ALL ".join(f"SELECT {key}, '{d}' AS detector_id, {secret.format(h=f'md5({key}::VARCHAR)')} AS secret FROM {table}" for d, secret, _ in PLANTED)
    return f"SELECT DISTINCT {key}, detector_id, secret FROM ({own} UNION ALL SELECT {key}, 'generic-assigned-secret', unnest(regexp_extract_all({body}, '{_sql_pattern(ASSIGNED)}', 2)) FROM {table})"


def _scan_planted(spark: SparkSession, sf_dir: str, table: str, key: str, body: str, opened: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """All detectors over all texts of a table, each with a secret of some families behind it."""
    texts = spread(_table(spark, sf_dir, table)).select(key, F.concat(F.coalesce(body, F.lit("")), *(F.expr(t.format(h=f"md5(cast({key} as string))")) for _, _, t in PLANTED)).alias("text"))
    return detect(opened(documents_as_sources(texts, key)))


@query(_planted_sql("doc_id", "documents", "coalesce(text, '')"))
def registry_scan(spark, sf_dir):
    """All detectors over all documents: the flagship."""
    found = _scan_planted(spark, sf_dir, "documents", "doc_id", "text")
    return found.select(F.substring_index("file", "/", -1).cast("long").alias("doc_id"), "detector_id", "secret")


@query(_planted_sql("page_id", "pages", "coalesce(html, '')"))
def registry_scan_pages(spark, sf_dir):
    found = _scan_planted(spark, sf_dir, "pages", "page_id", "html")
    return found.select(F.substring_index("file", "/", -1).cast("long").alias("page_id"), "detector_id", "secret")


@query(f"WITH {_FOUND_SQL} SELECT DISTINCT doc_id, detector_id, secret FROM found")
def registry_scan_tokens(spark, sf_dir):
    """The two detectors of ``_found`` through the whole detect stage, base64 runs included; documents as they are."""
    own = tuple(d for d in registry.load() if d.id in (TOKEN, ASSIGNED))
    texts = _with(_table(spark, sf_dir, "documents"), " ghp_", _id(97), "abcd ")
    found = detect(documents_as_sources(texts), own)
    return found.select(F.substring_index("file", "/", -1).cast("long").alias("doc_id"), "detector_id", "secret")


@query(_planted_sql("doc_id", "documents", "coalesce(text, '')"))
def archive_scan(spark, sf_dir):
    """The same findings where each document is a gzip archive: pack, open, detect."""
    found = _scan_planted(spark, sf_dir, "documents", "doc_id", "text", lambda rows: archives.opened(archives.gzipped(rows)))
    return found.select(F.regexp_extract("file", r"^documents/(\d+)\.gz!/\d+$", 1).cast("long").alias("doc_id"), "detector_id", "secret")


_ENTRIES_SQL = "SELECT 'supplier' || l_suppkey || '.zip!/line/' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '.txt' AS file, strlen(l_returnflag || l_linestatus || l_partkey)::BIGINT AS bytes FROM lineitem WHERE l_linenumber % 7 <> 0"


def _zip_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of zip archives, one a supplier; some names leave the archive."""
    name = F.when(F.col("l_linenumber") % 7 == 0, F.concat(F.lit("../line/"), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.lit("line/"), F.concat_ws("-", "l_orderkey", "l_linenumber"), F.lit("-"), F.col("l_partkey").cast("string"), F.lit(".txt")))
    content = F.concat("l_returnflag", "l_linestatus", F.col("l_partkey").cast("string")).cast("binary")
    return _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("supplier"), F.col("l_suppkey").cast("string"), F.lit(".zip")).alias("archive"), name.alias("name"), content.alias("content"))


@query(_ENTRIES_SQL)
def archive_entries(spark, sf_dir):
    """The archives opened again: virtual paths and sizes; names that leave the archive go."""
    return archives.opened(archives.zipped(_zip_entries(spark, sf_dir))).select("file", F.octet_length("content").cast("long").alias("bytes"))


@query(_ENTRIES_SQL)
def archive_ranges(spark, sf_dir):
    """The archives as files, opened where they lie by ranges of their directories, small enough here that an archive has several."""
    files_of = ranges.zip_files(_zip_entries(spark, sf_dir), tables.fresh(spark, "archives"))
    return ranges.opened(tables.written(files_of, "archive-files"), size=1024).select("file", F.octet_length("content").cast("long").alias("bytes"))


@query("SELECT DISTINCT 'c' || l_orderkey AS \"commit\", 'dir/' || l_partkey || chr(10) || 'x' AS path, md5(l_partkey::VARCHAR) AS oid FROM lineitem WHERE l_partkey % 11 <> 0")
def history_records(spark, sf_dir):
    """The changes of commits, written as a raw log's records, and parsed again; paths hold line breaks, some are renamed from others, some are links."""
    import pyarrow as pa

    from ..sources import git

    key = F.col("l_partkey").cast("string")
    path = F.concat(F.lit("dir/"), key, F.lit("\nx"))
    mode = F.when(F.col("l_partkey") % 11 == 0, "120000").otherwise("100644")
    how = F.when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("R090\x00old "), path)).otherwise(F.lit("A"))
    change = F.concat(F.lit(":000000 "), mode, F.lit(" 0000000 "), F.md5(key), F.lit(" "), how, F.lit("\x00"), path, F.lit("\x00"))
    logs = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(change)).alias("changes"))
    record = F.concat(F.lit("commit:c"), F.col("l_orderkey").cast("string"), F.lit("\x00\n"), F.array_join("changes", ""))

    def parsed(batches):
        for batch in batches:
            rows = [r for log in batch.column(0).to_pylist() for r in git.parse_raw(git.records(log.encode()))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["commit", "path", "oid"])

    return logs.select(record.alias("log")).mapInArrow(parsed, "commit string, path string, oid string")


@query("""SELECT 'https://github.com/' || source || '/r' || doc_id AS target, source AS owner FROM documents""")
def target_owners(spark, sf_dir):
    """Owner of each repository's address, by the library's own rule."""
    target = F.concat(F.lit("https://github.com/"), "source", F.lit("/r"), F.col("doc_id").cast("string"))
    return _table(spark, sf_dir, "documents").select(target.alias("target"), hosting.owner_of(target).alias("owner"))


@query("SELECT DISTINCT trim(source) AS target FROM documents WHERE source IS NOT NULL AND trim(source) <> '' AND trim(source) NOT LIKE '#%'")
def repository_list(spark, sf_dir):
    """A list of repositories as lines with blanks, comments and repeats."""
    docs = _table(spark, sf_dir, "documents")
    lines = docs.select(F.explode(F.array(F.concat(F.lit("  "), "source", F.lit(" ")), F.lit("# comment"), F.lit(""), F.col("source"))).alias("value"))
    return files.targets_of(lines)


@query("SELECT severity, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level, count(*) AS parts FROM (SELECT list_extract(['critical', 'high', 'medium', 'low'], (p_partkey % 4 + 1)::INT) AS severity FROM part) GROUP BY 1, 2")
def severity_levels(spark, sf_dir):
    own = F.element_at(F.array(*map(F.lit, ("critical", "high", "medium", "low"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = _table(spark, sf_dir, "part").select(own.alias("severity"))
    return rows.select("severity", findings.sarif_level(F.col("severity")).alias("level")).groupBy("severity", "level").agg(F.count("*").alias("parts"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
