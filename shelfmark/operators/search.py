"""Many ranked searches over the inverted index in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import js_trim, query_keywords
from shelfmark.operators.ranking import top_k
from shelfmark.session import stored

# Fixed advice texts.
ASK_FOR_QUERY = "Please provide a search query"
NO_ACTIVE_INDEX = "No active documentation index found. Please verify the indexer has run."
BE_SPECIFIC = "Try using more specific keywords"
BE_GENERAL = "Try using fewer or more general keywords"
FILTER_BY_TYPE = "Try filtering by type: documentation, template-pattern, or code-example"

#: Characters of the shortest term that :func:`query_keywords` lets through.
SHORTEST_TERM = 3



def bucket_of(key: Column, buckets: int) -> Column:
    """The partition of a stored index table in which a keyword or a hash stands."""
    return F.pmod(F.crc32(key.cast("binary")), F.lit(buckets)).cast("int")


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, term_pos, keyword``: the distinct terms of every query."""
    return queries.select("query_id", F.posexplode(query_keywords(F.col("text"))).alias("term_pos", "keyword"))


def search_scores(queries: DataFrame, postings: DataFrame, buckets: int | None = None, key: str = "hash") -> DataFrame:
    """``query_id, hash, total_score, first_pos``: summed relevance of the matched terms; ``key`` takes the place of the hash.

    With ``buckets`` the postings have a partition column ``bucket``, and the terms' buckets decide at run time which
    partitions are read at all.
    """
    terms, on, columns = query_terms(queries), ["keyword"], ["keyword", key, "relevance_score"]
    if buckets is not None:
        # Partitions are pruned by the terms where the plan says that these are a selection.
        terms = terms.where(F.length("keyword") >= SHORTEST_TERM).withColumn("bucket", bucket_of(F.col("keyword"), buckets))
        on, columns = ["bucket", *on], ["bucket", *columns]
    matched = terms.join(postings.select(*columns), on)
    return matched.groupBy("query_id", key).agg(
        F.sum("relevance_score").alias("total_score"), F.min("term_pos").alias("first_pos")
    )


def _ranking(key: str):
    return [F.col("total_score").desc(), F.col("first_pos"), F.col(key)]


def _wanted(meta_type: str, query_type: str):
    wanted = F.col(query_type)
    return wanted.isNull() | (wanted == "") | (F.col(meta_type) == wanted)


def ranked_hits(
    queries: DataFrame,
    postings: DataFrame,
    meta: DataFrame,
    limit: int = 10,
    owners: Sequence[str] | None = None,
    candidate_factor: int | None = None,
    buckets: int | None = None,
    key: str = "hash",
) -> DataFrame:
    """``query_id, hash, total_score, first_pos, rank, total_results`` of the best entries of every query.

    ``queries`` has ``query_id, text`` and optionally ``type, sub_type``.  Filters apply to all matches and
    ``total_results`` counts all that pass.  ``candidate_factor`` cuts at that multiple of ``limit`` before the type
    filters, as a saved search may want it: a result may then hold fewer rows than ``limit``, and counts inside the cut.
    The scores are stored, so the postings are read once.  ``key`` names an entry in the place of its hash, in the same order.
    """
    typed = [name for name in ("type", "sub_type") if name in queries.columns]
    for name in ("type", "sub_type"):
        if name not in queries.columns:
            queries = queries.withColumn(name, F.lit(None).cast("string"))
    filters = queries.select(
        "query_id", F.col("type").alias("want_type"), F.col("sub_type").alias("want_sub_type")
    )
    matches = _wanted("type", "want_type") & _wanted("sub_type", "want_sub_type")
    scores = search_scores(queries, postings, buckets, key)
    # Only the filter columns travel before the cut; titles and excerpts come after it.
    kinds = meta.select(key, "type", "sub_type", *(["owner"] if owners is not None else []))
    if owners is not None:
        kinds = kinds.where(F.col("owner").isin(list(owners))).drop("owner")
    if candidate_factor is not None:
        if owners is not None:
            scores = scores.join(kinds, key, "left_semi")
        scores = top_k(scores, ["query_id"], _ranking(key), candidate_factor * limit, "_candidate").drop("_candidate")
    if typed or owners is not None:
        scores = scores.join(kinds, key).join(filters, "query_id").where(matches)
        scores = scores.select("query_id", key, "total_score", "first_pos")
    # ranked and counted: stored, as the postings would be made for each of the two
    scores = stored(scores, "scores")
    totals = scores.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_results"))
    return top_k(scores, ["query_id"], _ranking(key), limit, "rank").join(totals, "query_id")


def hit_details(hits: DataFrame, meta: DataFrame, on: Sequence[str] = ("hash",)) -> DataFrame:
    """The hits with what a result shows of their entries."""
    details = meta.select(*on, "title", "excerpt", F.col("content_path").alias("file_path"), "type", "sub_type", "repository")
    return hits.join(details, list(on)).select(
        "query_id",
        "rank",
        "title",
        "excerpt",
        "file_path",
        "type",
        "sub_type",
        F.col("total_score").alias("relevance_score"),
        "repository",
        "total_results",
    )


def ranked_search(
    queries: DataFrame,
    postings: DataFrame,
    meta: DataFrame,
    limit: int = 10,
    owners: Sequence[str] | None = None,
    candidate_factor: int | None = None,
) -> DataFrame:
    """Ranked results of every query; see :func:`ranked_hits`.  ``IndexStore.search`` asks a stored index, and reads less.

    The hits are stored, so that their number is known before the entries' texts meet them.
    """
    return hit_details(stored(ranked_hits(queries, postings, meta, limit, owners, candidate_factor), "hits"), meta)


def suggestions(queries: DataFrame, results: DataFrame, has_active_index: bool = True) -> DataFrame:
    """``query_id, suggestions``: advice for queries without results, an empty array for the rest."""
    with_results = results.select("query_id").distinct().withColumn("_found", F.lit(True))
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<string>")
    advice = (
        F.when(js_trim(text) == "", F.array(F.lit(ASK_FOR_QUERY)))
        .when(F.lit(not has_active_index), F.array(F.lit(NO_ACTIVE_INDEX)))
        .when(F.size(query_keywords(text)) == 0, F.array(F.lit(BE_SPECIFIC)))
        .when(F.col("_found").isNull(), F.array(F.lit(BE_GENERAL), F.lit(FILTER_BY_TYPE)))
        .otherwise(none)
    )
    return queries.join(with_results, "query_id", "left").select("query_id", advice.alias("suggestions"))
