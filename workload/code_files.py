"""Code and template files made from the documents, their entries, chunks and template details."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators.chunks import chunk_content, get_chunks
from shelfmark.operators.code import code_entries, code_items, extract_errors
from shelfmark.operators.files import routed_files
from shelfmark.operators.templates import template_details, template_summaries
from shelfmark.plans.index import build_index
from shelfmark.session import spread, stored
from workload import adapters as A
from workload.registry import cte, query

_JS = (
    "class Box{i} {\n  /**\n   * {d}\n   * @param {string} userName - The name\n   * @returns {boolean} Done\n   */\n"
    "  static async getThing(userName) {\n    return {};\n  }\n}\n/** {d} */\nexport function run{i}(a, b) {\n}\n"
    "/** no function */\nconst x = 1;\n"
)
_PY = (
    "class Tool{i}(Base):\n    def do_it(self, user_name: str = 'x', *args):\n        \"\"\"{d}\n\n        Args:\n"
    "            user_name (str): The name\n                goes on.\n\n        Returns:\n            bool: ok\n        \"\"\"\n"
    "        pass\n\n    def __repr__(self):\n        \"\"\"Skipped.\"\"\"\n\nasync def main_{i}() -> int:\n    '''{d}'''\n"
)
_YAML = (
    "# Version: v1.{m}.0/2024-01-15\nDescription: \"{d}\"\nParameters:\n  UserPrefix{i}:\n    Type: String\n    Description: \"{d}\"\n"
    "    AllowedValues: [a, 2, true]\n    Default: !Ref Other\n    MinLength: 1\n  Bad: 5\n"
    "Resources:\n  Bucket{i}:\n    Type: AWS::S3::Bucket\n  Plain: 1\nOutputs:\n  Name:\n    Value: !GetAtt A.B\n"
)
_MARKS = {"{i}": "doc_id", "{d}": "d", "{m}": "m"}


def _fill_spark(template: str):
    parts = [template]
    for mark, column in _MARKS.items():
        split = []
        for part in parts:
            if isinstance(part, str):
                for n, piece in enumerate(part.split(mark)):
                    split += ([F.col(column).cast("string")] if n else []) + [piece]
            else:
                split.append(part)
        parts = split
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _fill_sql(template: str) -> str:
    text = "'" + template.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for mark, column in _MARKS.items():
        text = text.replace(mark, f"' || {column} || '")
    return text


def _described(t):
    # letters and blanks are collected: replacing what a negated class matches takes ten times as long
    letters = F.array_join(F.regexp_extract_all("text", F.lit("[A-Za-z ]+"), F.lit(0)), "")
    line = F.col("line")  # used twice below, so kept as a column of its own
    lines = spread(t.documents).withColumn("line", F.trim(F.regexp_replace(letters, " +", " ")))
    return lines.select(
        "doc_id",
        (F.col("doc_id") % 10).alias("m"),
        F.concat(F.lit("org"), F.col("doc_id") % 3).alias("owner"),
        F.col("source").alias("repo"),
        (F.col("doc_id") % 3).cast("int").alias("src_ord"),
        F.col("doc_id").alias("file_ord"),
        F.when(line == "", "Nothing here").otherwise(line).alias("d"),
    )


cte(
    "described",
    """SELECT doc_id, doc_id % 10 AS m, 'org' || (doc_id % 3) AS owner, source AS repo, CAST(doc_id % 3 AS INTEGER) AS src_ord, doc_id AS file_ord,
              CASE WHEN line = '' THEN 'Nothing here' ELSE line END AS d
       FROM (SELECT *, trim(regexp_replace(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' +', ' ', 'g')) AS line FROM documents)""",
)


def code_files(t):
    """One JavaScript, one Python and one template file per document; every seventh template is broken."""
    broken = F.col("doc_id") % 7 == 0
    files = F.array(
        F.struct(F.concat(F.lit("src/f"), "doc_id", F.lit(".js")).alias("path"), _fill_spark(_JS).alias("content")),
        F.struct(F.concat(F.lit("src/f"), "doc_id", F.lit(".py")).alias("path"), _fill_spark(_PY).alias("content")),
        F.struct(
            F.concat(F.lit("template-"), "doc_id", F.lit(".yml")).alias("path"),
            F.when(broken, "Parameters: [").otherwise(_fill_spark(_YAML)).alias("content"),
        ),
    )
    return _described(t).select("owner", "repo", "src_ord", "file_ord", F.inline(files))


def _entry_sql(path: str, title: str, content: str, words: str, kind: tuple[str, str], where: str = "", python: bool = False) -> str:
    fill = _fill_sql
    kw = A.sql_keywords(fill(words), stop=A.PYTHON_STOP, keep="a-z0-9_", sep="_") if python else A.sql_keywords(fill(words))
    full = f"owner || '/' || repo || '/' || {fill(path)}"
    return f"""SELECT owner, repo AS repository, src_ord, file_ord, {full} AS content_path, sha256({full}) AS hash,
                      {fill(title)} AS title, substring({fill(content)}, 1, 200) AS excerpt, {fill(content)} AS content,
                      '{kind[0]}' AS type, '{kind[1]}' AS sub_type, {kw} AS keywords FROM described {where}"""


_FUNCTION = ("code-example", "function")
cte(
    "js_entries",
    _entry_sql("src/f{i}.js/Box{i}/getThing", "Box{i}.getThing",
               "static async getThing(userName)\n\n{d}\n@param {string} userName - The name\n@returns {boolean} Done",
               "get thing user name {d}", _FUNCTION)
    + " UNION ALL "
    + _entry_sql("src/f{i}.js/run{i}", "run{i}", "export function run{i}(a, b)\n\n{d}", "run{i} {d}", _FUNCTION),
)
cte(
    "py_entries",
    _entry_sql("src/f{i}.py/Tool{i}/do_it", "Tool{i}.do_it",
               "def do_it(self, user_name: str = 'x', *args):\n\n{d}\n\nArgs:\n    user_name (str): The name goes on.\n\nReturns:\n    bool: ok",
               "do it user name args {d}", _FUNCTION, python=True)
    + " UNION ALL "
    + _entry_sql("src/f{i}.py/main_{i}", "main_{i}", "async def main_{i}() -> int:\n\n{d}", "main {i} {d}", _FUNCTION, python=True),
)
cte(
    "cfn_entries",
    _entry_sql("template-{i}.yml/Parameters/UserPrefix{i}", "UserPrefix{i}",
               "Parameter: UserPrefix{i}\nType: String\nDescription: {d}\nDefault: Other\nAllowedValues: a, 2, true\nMinLength: 1",
               "user prefix{i} {d}", ("template-pattern", "parameter"), "WHERE doc_id % 7 <> 0"),
)

_COLUMNS = "content_path, hash, title, excerpt, content, type, sub_type, array_to_string(keywords, ' ') AS keywords"


def _shown(df):
    return df.select(
        "content_path", "hash", "title", "excerpt", "content", "type", "sub_type", F.array_join("keywords", " ").alias("keywords")
    )


def _of_kind(t, kind):
    return _shown(code_entries(routed_files(code_files(t)).where(F.col("kind") == kind)))


@query("jsdoc_entries", f"SELECT {_COLUMNS} FROM js_entries")
def _(t):
    return _of_kind(t, "jsdoc")


@query("python_entries", f"SELECT {_COLUMNS} FROM py_entries")
def _(t):
    return _of_kind(t, "python")


@query("template_parameter_entries", f"SELECT {_COLUMNS} FROM cfn_entries")
def _(t):
    return _of_kind(t, "cfn")


@query("extract_errors", "SELECT owner, repo, path, 'x' AS kind FROM files_md WHERE false")
def _(t):
    """No generated file makes an extractor fail."""
    return extract_errors(code_items(routed_files(code_files(t)))).select("owner", "repo", "path", "kind")


def all_files(t):
    return A.files_md(t).unionByName(code_files(t).withColumn("file_ord", F.col("file_ord")))


cte(
    "all_entries",
    """SELECT * FROM (
         SELECT owner, repository, src_ord, file_ord, sec_ord, content_path, hash, title, excerpt, content, type, sub_type, keywords FROM md_entries
         UNION ALL SELECT owner, repository, src_ord, file_ord, 0, content_path, hash, title, excerpt, content, type, sub_type, keywords
         FROM (SELECT * FROM js_entries UNION ALL SELECT * FROM py_entries UNION ALL SELECT * FROM cfn_entries))
       QUALIFY row_number() OVER (PARTITION BY hash ORDER BY src_ord, repository, file_ord, sec_ord) = 1""",
)


@query(
    "build_index_entries",
    "SELECT hash, content_path, title, type, sub_type, array_to_string(keywords, ' ') AS keywords FROM all_entries",
)
def _(t):
    entries, _postings = build_index(all_files(t))
    return entries.select("hash", "content_path", "title", "type", "sub_type", F.array_join("keywords", " ").alias("keywords"))


@query(
    "build_index_postings",
    """SELECT keyword, hash, type_weight,
              CAST(floor((CASE WHEN contains(lower(title), keyword) THEN 10 ELSE 0 END
                + CASE WHEN contains(lower(content), keyword) THEN 5 ELSE 0 END + 3) * type_weight + 0.5) AS INTEGER) AS relevance_score
       FROM (SELECT *, CASE type WHEN 'documentation' THEN 1.0::DOUBLE WHEN 'template-pattern' THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS type_weight,
                    unnest(keywords) AS keyword FROM all_entries)""",
)
def _(t):
    _entries, rows = build_index(all_files(t))
    return rows


# --- templates ----------------------------------------------------------------------------------


def _template_files(t):
    return code_files(t).where(F.col("path").endswith(".yml")).select(F.col("file_ord").alias("key"), "content")


@query(
    "template_details",
    """SELECT doc_id AS key, CASE WHEN ok THEN 'v1.' || m || '.0/2024-01-15' END AS version, CASE WHEN ok THEN d ELSE '' END AS description,
              CASE WHEN ok THEN 'UserPrefix' || doc_id || '|Bad' ELSE '' END AS parameters, CASE WHEN ok THEN '{"Ref":"Other"}' END AS default_value,
              CASE WHEN ok THEN 'Bucket' || doc_id || '=AWS::S3::Bucket|Plain=Unknown' ELSE '' END AS resources,
              CASE WHEN ok THEN 'Name' ELSE '' END AS outputs
       FROM (SELECT *, doc_id % 7 <> 0 AS ok FROM described)""",
)
def _(t):
    details = template_details(_template_files(t))
    first = F.get(F.map_values("parameters"), F.lit(0))
    pairs = F.transform(F.map_entries("resources"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return details.select(
        "key",
        "version",
        "description",
        F.array_join(F.map_keys("parameters"), "|").alias("parameters"),
        F.try_element_at(first, F.lit("Default")).alias("default_value"),
        F.array_join(pairs, "|").alias("resources"),
        F.array_join(F.map_keys("outputs"), "|").alias("outputs"),
    )


@query(
    "template_header_versions",
    "SELECT doc_id AS key, CASE WHEN doc_id % 7 <> 0 THEN 'v1.' || m || '.0/2024-01-15' END AS version FROM described",
)
def _(t):
    from shelfmark.functions.versions import human_version

    return _template_files(t).select("key", human_version(F.col("content")).alias("version"))


@query(
    "template_summaries",
    """SELECT doc_id AS key, CASE WHEN ok THEN 'v1.' || m || '.0/2024-01-15' END AS version, CASE WHEN ok THEN d ELSE '' END AS description,
              CASE WHEN ok THEN 'Bucket' || doc_id || ':AWS::S3::Bucket' END AS first_resource, bytes > 400 AS content_truncated, bytes AS content_bytes
       FROM (SELECT *, doc_id % 7 <> 0 AS ok, CAST(CASE WHEN ok THEN strlen(""" + _fill_sql(_YAML) + ") ELSE 13 END AS INTEGER) AS bytes FROM described)",
)
def _(t):
    found = template_summaries(_template_files(t), threshold=400, chunk_bytes=100)
    first = F.get("resources", F.lit(0))
    return found.select(
        "key", "version", "description", F.concat(first["logical_id"], F.lit(":"), first["type"]).alias("first_resource"),
        "content_truncated", "content_bytes",
    )


# --- chunks -------------------------------------------------------------------------------------

_LIMIT = 1000


@query(
    "chunk_invariants",
    f"""SELECT doc_id, true AS within_limit, true AS in_order, strlen(replace(text, chr(10), '')) AS text_bytes,
               CASE WHEN longest <= {_LIMIT} THEN text ELSE replace(text, chr(10), '') END AS restored
        FROM (SELECT *, list_max(list_transform(string_split(text, chr(10)), lambda l: strlen(l))) AS longest FROM documents)""",
)
def _(t):
    """Chunks fit, are numbered without gaps, and give the text back (up to line feeds where a line was cut)."""
    chunks = chunk_content(t.documents, "doc_id", "text", _LIMIT)
    per_doc = chunks.groupBy("doc_id").agg(
        (F.max(F.octet_length("chunk")) <= _LIMIT).alias("within_limit"),
        F.max("chunk_index").alias("last"),
        F.count(F.lit(1)).alias("n"),
        F.max("total_chunks").alias("total"),
        F.array_sort(F.collect_list(F.struct("chunk_index", "chunk"))).alias("parts"),
    )
    longest = F.array_max(F.transform(F.split("text", "\n"), F.octet_length))
    joined = t.documents.select("doc_id", (longest <= _LIMIT).alias("whole_lines")).join(per_doc, "doc_id")
    text = F.transform("parts", lambda p: p["chunk"])
    flat = F.regexp_replace(F.array_join(text, "\n"), "\n", "")
    return joined.select(
        "doc_id",
        "within_limit",
        ((F.col("last") + 1 == F.col("total")) & (F.col("n") == F.col("total"))).alias("in_order"),
        F.octet_length(flat).cast("bigint").alias("text_bytes"),
        F.when(F.col("whole_lines"), F.array_join(text, "\n")).otherwise(flat).alias("restored"),
    )


cte(
    "chunks",
    f"""
    WITH RECURSIVE marks AS (
      SELECT doc_id, list(b ORDER BY i) AS ends, max(i) AS n,
             list_concat(CASE WHEN first(c ORDER BY i) = chr(10) THEN [{{'i': CAST(0 AS BIGINT), 'b': CAST(0 AS HUGEINT)}}] ELSE [] END,
                         list({{'i': i, 'b': b}} ORDER BY i) FILTER (WHERE line_end)) AS lines
      FROM (SELECT doc_id, i, c, sum(strlen(c)) OVER w AS b, coalesce(lead(c) OVER w, chr(10)) = chr(10) AS line_end
            FROM (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE text <> '')
            WINDOW w AS (PARTITION BY doc_id ORDER BY i))
      GROUP BY doc_id),
    -- a chunk ends at the last line end within the limit, else at the last character within it
    walk AS (
      SELECT doc_id, 0 AS chunk_index, CAST(0 AS BIGINT) AS started, CAST(-1 AS BIGINT) AS ended, CAST(-1 AS BIGINT) AS goes_on FROM marks
      UNION ALL
      SELECT doc_id, chunk_index + 1, goes_on, ended, CASE WHEN by_line IS NOT NULL THEN ended + 1 ELSE ended END
      FROM (SELECT *, coalesce(by_line, len(list_filter(ends, lambda x: x <= base + {_LIMIT}))) AS ended
            FROM (SELECT doc_id, chunk_index, goes_on, ends, base,
                         list_last(list_filter(lines, lambda x: x.i >= goes_on AND x.b <= base + {_LIMIT})).i AS by_line
                  FROM (SELECT w.doc_id, w.chunk_index, greatest(w.goes_on, 0) AS goes_on, m.ends, m.lines, m.n,
                               CASE WHEN w.goes_on <= 0 THEN 0 ELSE m.ends[w.goes_on] END AS base
                        FROM walk w JOIN marks m USING (doc_id) WHERE w.goes_on <= m.n)))
    )
    SELECT w.doc_id, w.chunk_index - 1 AS chunk_index, substring(d.text, w.started + 1, w.ended - w.started) AS chunk
    FROM walk w JOIN documents d USING (doc_id) WHERE w.chunk_index > 0
    UNION ALL SELECT doc_id, 0, '' FROM documents WHERE text = ''
    """,
)


@query(
    "chunk_content",
    "SELECT doc_id, chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS total_chunks, chunk FROM chunks",
)
def _(t):
    return chunk_content(t.documents, "doc_id", "text", _LIMIT)


@query(
    "get_chunk",
    """SELECT doc_id AS want_id, chunk_index, chunk, NULL AS code, NULL AS message FROM chunks
       UNION ALL SELECT doc_id, CAST(n AS INTEGER), NULL, 'INVALID_CHUNK_INDEX', 'chunkIndex ' || n || ' is out of range. Valid range: 0-' || (n - 1)
       FROM (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id)
       UNION ALL SELECT -1 - doc_id, 0, NULL, 'TEMPLATE_NOT_FOUND', NULL FROM documents""",
)
def _(t):
    """Every chunk of every document, the index behind the last, and a document that is not there."""
    chunks = stored(chunk_content(t.documents, "doc_id", "text", _LIMIT), "chunks")
    indexes = F.explode(F.sequence(F.lit(0), F.col("total_chunks"))).alias("chunk_index")
    wanted = chunks.where("chunk_index = 0").select(F.col("doc_id").alias("want_id"), "doc_id", indexes)
    absent = (-1 - F.col("doc_id")).alias("want_id")
    wanted = wanted.unionByName(t.documents.select(absent, absent.alias("doc_id"), F.lit(0).alias("chunk_index")))
    return get_chunks(wanted, chunks, "doc_id").select("want_id", "chunk_index", "chunk", "code", "message")
