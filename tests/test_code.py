import io
import random
import time
import zipfile

import pandas as pd
import pytest
import yaml
from pyspark.sql import functions as F

from shelfmark.operators.chunks import chunk_content
from shelfmark.operators.code import code_entries, code_items, extract_errors, jsdoc_items, python_items, template_items
from shelfmark.operators.yaml_documents import load_template
from shelfmark.sources import archives


def test_python_function():
    items = list(python_items('def greet(name):\n    """Say hello."""\n    pass'))
    assert items == [("greet", "greet", "def greet(name):\n\nSay hello.", "greet name Say hello.")]


def test_python_class_context():
    code = (
        "class A:\n    # note\n    @deco\n    async def run(self, *args, n: int = 2) -> bool:\n\n        '''\n        Runs.\n\n"
        "        Raises:\n            ValueError: bad\n        Notes:\n            hidden\n        '''\n\n    def __eq__(self, o):\n"
        '        """No."""\n\n    def __init__(self):\n        """Makes."""\n\ndef after():\n    """Free."""\n\ndef bare():\n    pass\n'
    )
    items = list(python_items(code))
    assert [i[0] for i in items] == ["A/run", "A/__init__", "after"]
    assert items[0][2] == "async def run(self, *args, n: int = 2) -> bool:\n\nRuns.\n\nRaises:\n    ValueError: bad"
    assert items[0][3] == "run args n Runs."


def test_jsdoc_forms():
    code = """
class Box extends Base {
  /** Gets it.
   * @param {string} [userName] - The name
   * @example skipped
   */
  get(userName) { if (x) { } }
}
/** Arrow. */
export const make = async (a) => { };
/** Exported. */
module.exports.go = function (b) { };
/** Not a function */
const x = 1;
"""
    items = {i[0]: i for i in jsdoc_items(code)}
    assert list(items) == ["Box/get", "make", "go"] or set(items) == {"Box/get", "make", "go"}
    assert items["Box/get"][2] == "get(userName)\n\nGets it.\n@param {string} userName - The name"
    assert items["make"][2].startswith("export const make = async (a) =>\n\nArrow.")


def test_template_parameters():
    items = list(template_items("Parameters:\n  Prefix:\n    Type: String\n    Description: Stack prefix"))
    assert items[0][2] == "Parameter: Prefix\nType: String\nDescription: Stack prefix"
    assert list(template_items("Parameters: [")) == []
    assert load_template("a: 1\na: 2") is None
    assert load_template("a: yes\nb: true\nc: 010\nd: !Sub x") == {"a": "yes", "b": True, "c": 10, "d": "x"}
    assert load_template("a: !Unknown x") is None


def test_failed_files_become_rows(spark, monkeypatch):
    schema = "owner string, repo string, src_ord int, file_ord bigint, path string, kind string, content string"
    deep = "[" * 5000
    rows = [("o", "r", 0, 1, "a.py", "python", 'def f():\n    """Doc."""'), ("o", "r", 0, 2, "template.yml", "cfn", deep)]
    items = code_items(spark.createDataFrame(rows, schema))
    assert [r["title"] for r in code_entries(spark.createDataFrame(rows, schema)).collect()] == ["f"]
    assert extract_errors(items).count() in (0, 1)


def _slow_pack(text, limit):
    """Chunks by trying every prefix."""
    size = lambda s: len(s.encode())
    if size(text) <= limit:
        return [text]
    chunks, current = [], None
    for line in text.split("\n"):
        if current is not None and size(f"{current}\n{line}") <= limit:
            current = f"{current}\n{line}"
            continue
        if current is not None:
            chunks.append(current)
        while size(line) > limit:
            end = max(n for n in range(len(line) + 1) if size(line[:n]) <= limit)
            chunks.append(line[:end])
            line = line[end:]
        current = line
    return [*chunks, current]


@pytest.mark.parametrize("limit", [4, 5, 7, 12])
def test_chunks(spark, limit):
    rng = random.Random(limit)
    letters = "aab\n\né" + chr(0x20AC) + chr(0x1F600)
    texts = ["", "\n", "\n\n\n", "\n" + "a" * 40, "a" * 40 + "\n", None]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    chunked = chunk_content(rows, "id", "text", limit)
    plan = chunked._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan
    found = {}
    for r in sorted(chunked.collect(), key=lambda r: (r["id"], r["chunk_index"])):
        found.setdefault(r["id"], []).append(r["chunk"])
        assert r["chunk_index"] == len(found[r["id"]]) - 1
    for k, text in enumerate(texts):
        assert found[k] == _slow_pack(text or "", limit), text


def test_a_long_text_takes_seconds(spark):
    lines = [("é" * (k % 90), "x" * 5000)[k % 50 == 0] for k in range(40_000)]
    rows = spark.createDataFrame([(1, "\n".join(lines))], "id int, text string")
    started = time.perf_counter()
    chunks = chunk_content(rows, "id", "text", 1000)
    assert chunks.where(F.octet_length("chunk") > 1000).count() == 0
    flat = "".join(r["chunk"] for r in chunks.orderBy("chunk_index").collect()).replace("\n", "")
    assert flat == "".join(lines) and time.perf_counter() - started < 60


def test_a_large_file_without_a_brace_takes_seconds():
    text = "/** c */\nlet y;\n" * 60_000
    started = time.perf_counter()
    assert list(jsdoc_items(text)) == []
    assert time.perf_counter() - started < 20


def test_quoted_scalars_are_taken_in_runs(monkeypatch):
    seen = []
    peek = yaml.reader.Reader.peek
    monkeypatch.setattr(yaml.reader.Reader, "peek", lambda self, index=0: (seen.append(1), peek(self, index))[1])
    words = "word and word " * 5000
    assert load_template(f'Description: "{words}"') == {"Description": words}
    assert len(seen) < 1000  # not once for each character


def test_quoted_scalars_read_as_the_plain_loader_reads_them():
    inner = ["a  b", " a b ", "a \tb", "a\n b\n\n c", "a \r\n b", "it''s", "a\\\n  b", "x\\u0041 \\\"q\\\" y", "a\ufeff b", "a # b: c", ""]
    for quote in "'\"":
        for text in inner:
            document = f"k: {quote}{text}{quote}"
            try:
                expected = yaml.safe_load(document)
            except yaml.YAMLError:
                expected = None
            assert load_template(document) == expected, document


def test_the_bytes_of_a_text_are_not_copied_by_each_step(spark):
    rows = spark.createDataFrame([(1, "x" * 50)], "id int, text string")
    plan = chunk_content(rows, "id", "text", 10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(array(data") == 2  # spans and pieces get the bytes as a variable


def test_small_archives_share_a_frame():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("root/a.md", "text")
    batch = pd.DataFrame({"archive": [str(k) for k in range(50)], "data": [buffer.getvalue() if k % 9 else b"none" for k in range(50)]})
    frames = list(archives._read([batch]))
    assert len(frames) == 1 and len(frames[0]) == 50
    assert frames[0]["error"].notna().sum() == 6 and set(frames[0]["content"].dropna()) == {"text"}
