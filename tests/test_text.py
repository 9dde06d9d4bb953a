import pytest
from pyspark.sql import functions as F

from shelfmark.functions import naming, requests, site, text, versions
from shelfmark.operators import files, readme
from shelfmark.operators.sections import markdown_entries, markdown_sections

NBSP = chr(0xA0)


@pytest.mark.parametrize(
    "heading, slug",
    [
        ("Getting Started", "getting-started"),
        ("API Reference (v2)", "api-reference-v2"),
        ("foo  --  bar", "foo-bar"),
        ("  Hello World  ", "hello-world"),
        ("a" + NBSP + "b", "a-b"),
        ("Été", "t"),
        ("!!!", ""),
    ],
)
def test_slugify(one, heading, slug):
    assert one(heading, text.slugify) == slug


@pytest.mark.parametrize(
    "source, words",
    [
        ("Install the build-tools package", ["install", "build-tools", "package"]),
        ("install install install", ["install"]),
        ("the a an", []),
        ("été -- x y2", ["--", "y2"]),
        ("a" + NBSP + "bc", ["bc"]),
    ],
)
def test_keywords(one, source, words):
    assert one(source, text.keywords) == words


def test_keyword_variants(one):
    assert one("do_it user_name returns", text.python_keywords) == ["user", "name"]
    # Two-letter terms are indexed but cannot be searched.
    assert one("go the v2 index index", text.query_keywords) == ["index"]
    assert one(None, text.query_keywords) == []


def test_small_functions(one):
    assert one("org-a, acme-corp , test-org,,", text.csv_list) == ["org-a", "acme-corp", "test-org"]
    assert one("use-cases", site.directory_title) == "Use cases"
    assert one("UserName", text.camel_split) == " User Name"
    assert [one(v, versions.version_format) for v in ("v1.3.4/2024-01-10", "v1.3.4", "abc")] == [
        "HUMAN_READABLE_VERSION", "SHORT_VERSION", "S3_VERSION_ID",
    ]
    assert one(None, lambda c: versions.version_parts(c)["major"]) == 0
    assert [one(s, naming.is_valid_stage) for s in ("test", "tjoe", "xyz", None)] == [True, True, False, False]
    assert one("MyFunction", naming.pascal_case_warnings) == []
    assert len(one("getAPI", naming.pascal_case_warnings)) == 2
    assert one("us-east-1-x-eu-west-2-y", naming.region_from_right) == "eu-west-2"
    assert one(" 1.2.3.4 , 5.6.7.8", lambda c: requests.client_id(c, F.lit("9.9.9.9"))) == "1.2.3.4"
    assert one("", lambda c: requests.client_id(c, F.lit(""))) == "unknown"
    assert one("300001", lambda c: requests.ms_to_minutes(c.cast("bigint"))) == 6


@pytest.mark.parametrize(
    "path, expected",
    [
        ("README.md", True), ("src/index.js", True), ("template.yml", True), ("config.yml", False), ("LICENSE.md", False),
        (".github/workflows/ci.yml", False), ("src/tests/unit/foo.test.js", False), ("lib/node_modules/pkg/index.js", False),
        ("README.MD", True), ("src/.js", False), ("testsuite/a.py", True), ("Template-x.YAML", True),
    ],
)
def test_indexable(one, path, expected):
    assert one(path, files.is_indexable) is expected


def test_case_sensitive_routing(one):
    assert one("README.MD", files.extractor_kind) is None
    assert one("a/template.yaml", files.extractor_kind) == "cfn"


def _files(spark, *contents):
    rows = [("o", "r", 0, i, f"f{i}.md", c) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, "owner string, repo string, src_ord int, file_ord int, path string, content string")


def test_sections(spark):
    levels = "\n".join(f"{'#' * n} H{n}\nbody{n}" for n in range(1, 7))
    rows = markdown_sections(_files(spark, levels)).orderBy("sec_ord").collect()
    assert [(r["heading"], r["level"], r["body"]) for r in rows] == [(f"H{n}", n, f"body{n}") for n in range(1, 7)]


def test_section_traps(spark):
    crlf = "# Title\r\ntext"
    fenced = "before\n# A\n```\n# in fence\n```\n####### seven\n#none\n# \n## B"
    rows = markdown_sections(_files(spark, crlf, fenced)).orderBy("file_ord", "sec_ord").collect()
    assert [(r["file_ord"], r["heading"]) for r in rows] == [(1, "A"), (1, "in fence"), (1, "B")]
    assert rows[0]["body"] == "```"
    assert rows[1]["body"] == "```\n####### seven\n#none\n#"


def test_entries(spark):
    rows = markdown_entries(_files(spark, "# Install\nRun npm install\n# !!!\nx\n# The\n")).collect()
    entry = next(r for r in rows if r["title"] == "Install")
    assert (entry["content_path"], entry["keywords"]) == ("o/r/f0.md/install", ["install", "run", "npm"])
    assert len(entry["hash"]) == 64
    assert {r["title"]: r["keywords"] for r in rows}["The"] == ["the"]
    assert len(rows) == 2


def test_readme_table_row_and_columns(spark):
    table = "| | Build & Deploy | Application Stack |\n|-|-|-|\n| **Features** | - | a, b |\n| Languages | Bash | X |"
    row = readme.stack_table(spark.createDataFrame([("o", "r", table)], "owner string, repo string, content string")).first()
    assert row["has_table"] and row["has_features_row"]
    assert row["features"]["applicationStack"] == ["a", "b"] and row["features"]["buildDeploy"] == []
    assert row["languages"]["buildDeploy"] == ["Bash"]


def test_html(one):
    page = "<html><BODY class='x'><p>$1</p></body></html>"
    assert one(page, lambda c: site.inject_breadcrumb(c, F.lit("<nav>$2</nav>"))).startswith("<html><BODY class='x'><nav>$2</nav><p>")
    assert one(page, site.inject_footer).count("copyright-year") == 1
    assert one("no body", site.inject_footer) == "no body"
    links = """<a href="x/README.md">1</a><a href='y.md#z'>2</a><a href="k.md?x">3</a>"""
    assert one(links, site.rewrite_links) == """<a href="x/index.html">1</a><a href='y.html#z'>2</a><a href="k.md?x">3</a>"""


def test_sections_are_cut_once(spark):
    plan = markdown_sections(_files(spark, "# A\nx\n"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_in_line_is_all_but_the_line_ends(one):
    every = "".join(chr(c) for c in [*range(0x3000), 0xFEFF, 0xFFFF, 0x10000, 0x10FFFF])
    kept = one(every, lambda s: F.array_join(F.regexp_extract_all(s, F.lit(f"[{text.IN_LINE}]+"), F.lit(0)), ""))
    assert kept == one(every, lambda s: F.regexp_replace(s, f"[{text.LINE_ENDS}]", ""))
    assert set(every) - set(kept) == set("\n\r\u2028\u2029")
