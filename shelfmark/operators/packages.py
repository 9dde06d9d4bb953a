"""Package manifests, requirements and what the files of a repository tell about it.

``files`` has ``owner, repo, path, content``; results have one row per repository that has something to say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import js_trim, literal_array
from shelfmark.operators.ranking import first_wins

REPO = ["owner", "repo"]

# Fixed values.
NESTED_SOURCES = "application-infrastructure/src"
NODE_FRAMEWORKS = {"express": "Express", "fastify": "Fastify", "koa": "Koa", "next": "Next.js", "react": "React"}
PYTHON_FRAMEWORKS = {"fastapi": "FastAPI", "flask": "Flask", "django": "Django"}
#: Feature label -> pattern one of the paths must match.
PATH_FEATURES = {
    "CloudFormation template": r"\Atemplate\.ya?ml\z",
    "CodeBuild integration": r"\Abuildspec\.yml\z",
    "GitHub Actions": r"\A\.github/workflows(/|\z)",
    "Unit tests": r"\Atests?(/|\z)",
    "AWS Lambda": r"\Asrc/lambda(/|\z)",
}
LANGUAGE_PREREQUISITES = {
    "Node.js": ["Node.js 18.x or later", "npm or yarn"],
    "Python": ["Python 3.9 or later", "pip"],
}
TEMPLATE_PREREQUISITES = ["AWS CLI configured", "AWS SAM CLI"]
README_NAMES = ["README.md", "readme.md", "README.MD"]

_MANIFEST = (
    "name string, description string, version string, author string, license string, "
    "dependencies map<string, string>, devDependencies map<string, string>, _broken string"
)


def _texts() -> Column:
    return F.array().cast("array<string>")


def manifests(files: DataFrame, nested: str = NESTED_SOURCES) -> DataFrame:
    """Readable package manifests with their priority: root, nested sources, then two levels below them in path order."""
    path = F.col("path")
    priority = (
        F.when(path == "package.json", 0)
        .when(path == f"{nested}/package.json", 1)
        .when(path.rlike(rf"\A{nested}/[^/]+/[^/]+/package\.json\z"), 2)
    )
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    return (
        files.where(path.endswith("package.json"))
        .select(*REPO, "path", priority.alias("priority"), F.from_json("content", _MANIFEST, options).alias("doc"))
        .where(F.col("priority").isNotNull() & F.col("doc").isNotNull() & F.col("doc._broken").isNull())
    )


def _ordered_names(found: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct map keys per repository in order of first occurrence; each name is reduced before it is collected."""
    names = found.select(*REPO, "priority", "path", F.posexplode(F.map_keys(f"doc.{column}")).alias("pos", "dep"))
    first = names.groupBy(*REPO, "dep").agg(F.min(F.struct("priority", "path", "pos")).alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "dep")))
    return first.groupBy(*REPO).agg(F.transform(ordered, lambda x: x["dep"]).alias(name))


def package_metadata(files: DataFrame, cache_package: str, nested: str = NESTED_SOURCES) -> DataFrame:
    """Name and the like from the first readable manifest, dependencies of all of them in order."""
    found = manifests(files, nested)
    head = first_wins(found, REPO, ["priority", "path"])
    fields = ["name", "description", "version", "author", "license"]
    return (
        head.select(*REPO, *[F.coalesce(f"doc.{f}", F.lit("")).alias(f) for f in fields])
        .join(_ordered_names(found, "dependencies", "dependencies"), REPO, "left")
        .join(_ordered_names(found, "devDependencies", "dev_dependencies"), REPO, "left")
        .withColumns({c: F.coalesce(c, _texts()) for c in ("dependencies", "dev_dependencies")})
        .withColumn("has_cache_data", F.array_contains("dependencies", cache_package))
    )


def requirement_names(content: Column) -> Column:
    """Names of a requirements file: no blank lines or comments, cut at a version bound."""
    lines = F.filter(F.split(content, "\n"), lambda x: (js_trim(x) != "") & ~x.startswith("#"))
    return F.transform(lines, lambda x: F.regexp_replace(js_trim(x), "(==|>=|<=).*", ""))


def requirements(files: DataFrame) -> DataFrame:
    """``owner, repo, requirements, requirements_text`` of repositories with a root requirements file."""
    return files.where(F.col("path") == "requirements.txt").select(
        *REPO, requirement_names(F.col("content")).alias("requirements"), F.lower("content").alias("requirements_text")
    )


def root_dependencies(files: DataFrame) -> DataFrame:
    """Dependency names of the root manifest only."""
    return manifests(files).where("priority = 0").select(
        *REPO, F.coalesce(F.map_keys("doc.dependencies"), _texts()).alias("root_dependencies")
    )


def frameworks(root_deps: Column, requirements_text: Column) -> Column:
    node = [F.when(F.array_contains(root_deps, k), v) for k, v in NODE_FRAMEWORKS.items()]
    python = [F.when(requirements_text.contains(k), v) for k, v in PYTHON_FRAMEWORKS.items()]
    return F.array_compact(F.array(*node, *python))


def path_features(files: DataFrame) -> DataFrame:
    """One boolean per path feature and ``has_template_yml``, per repository, by partial aggregation."""
    found = [F.max(F.col("path").rlike(p)).alias(label) for label, p in PATH_FEATURES.items()]
    return files.groupBy(*REPO).agg(*found, F.max(F.col("path") == "template.yml").alias("has_template_yml"))


def features(has_cache_package: Column, cache_feature: str) -> Column:
    """Feature labels, given the columns of :func:`path_features`."""
    labels = [F.when(has_cache_package, cache_feature)] + [F.when(F.col(label), label) for label in PATH_FEATURES]
    return F.array_compact(F.array(*labels))


def inferred_prerequisites(languages: Column, has_template: Column) -> Column:
    parts = [
        F.when(F.array_contains(languages, name), literal_array(texts)).otherwise(_texts())
        for name, texts in LANGUAGE_PREREQUISITES.items()
    ]
    parts.append(F.when(has_template, literal_array(TEMPLATE_PREREQUISITES)).otherwise(_texts()))
    return F.concat(*parts)


def root_readmes(files: DataFrame) -> DataFrame:
    """The README of every repository, by preference among its spellings."""
    spellings = files.where(F.col("path").isin(README_NAMES))
    order = F.array_position(literal_array(README_NAMES), F.col("path"))
    return first_wins(spellings, REPO, [order]).select(*REPO, "content")
