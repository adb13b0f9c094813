"""Over-representation of terms in studies; all studies are tested in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from helixframe.functions import tails
from helixframe.operators.statistics import adjust
from helixframe.session import cut_lineage


def enrichment_counts(study: DataFrame, gene_terms: DataFrame, population: int | None = None) -> DataFrame:
    """(study, term, study_hits, study_size, term_size, population) of the terms with a study gene.

    Without a given population, annotated genes are the population and unannotated study genes
    do not count.
    """
    pairs = gene_terms.select("gene", "term").distinct()
    genes = study.select("study", "gene").distinct()
    annotated = pairs.select("gene").distinct()
    counted = genes if population else genes.join(annotated, "gene", "left_semi")
    sizes = counted.groupBy("study").agg(F.count("*").alias("study_size"))
    term_sizes = pairs.groupBy("term").agg(F.count("*").alias("term_size"))
    hits = genes.join(pairs, "gene").groupBy("study", "term").agg(F.count("*").alias("study_hits"))
    total = F.lit(population).cast("long") if population else annotated.agg(F.count("*").alias("n")).scalar()
    return hits.join(sizes, "study").join(term_sizes, "term").withColumn("population", total)


def enrich(study: DataFrame, gene_terms: DataFrame, population: int | None = None, method: str = "fdr_bh", alpha: float = 0.05) -> DataFrame:
    """Upper-tail hypergeometric p, corrected p per study, and the label e (enriched) or p."""
    counts = enrichment_counts(study, gene_terms, population)
    # The correction reads the p values several times, so they are computed once and kept.
    p = cut_lineage(counts.withColumn(
        "p", tails.hypergeometric_p(F.col("study_hits"), F.col("population"), F.col("term_size"), F.col("study_size"))
    ))
    return adjust(p, ["study"], "p", method, "q", alpha).withColumn("label", F.when(F.col("q") <= alpha, "e").otherwise("p"))


def ratios(enriched: DataFrame) -> DataFrame:
    def ratio(a: str, b: str) -> Column:
        return F.concat_ws("/", F.col(a).cast("string"), F.col(b).cast("string"))

    return enriched.withColumn("ratio_in_study", ratio("study_hits", "study_size")).withColumn(
        "ratio_in_pop", ratio("term_size", "population")
    )


def top_terms(enriched: DataFrame, k: int, by: list[str]) -> DataFrame:
    """The k terms of lowest p per study and further keys; only k rows per key leave each map task."""
    w = W.partitionBy("study", *by).orderBy("p", "term")
    return enriched.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def term_members(study: DataFrame, gene_terms: DataFrame, symbols: DataFrame) -> DataFrame:
    """(study, term, gene, info): the study genes of each term as ``gene|direction|symbol``, one row each."""
    pairs = gene_terms.select("gene", "term").distinct()
    named = study.select("study", "gene", "direction").distinct().join(pairs, "gene").join(symbols, "gene", "left")
    direction = F.when(F.col("direction") != "", F.col("direction"))
    return named.select("study", "term", "gene", F.concat_ws("|", F.col("gene").cast("string"), direction, "symbol").alias("info"))


def decorate_lists(table: DataFrame, study: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rewrite a comma list of study genes (`row_id`, `study_items`) as ``gene|direction|symbol;…`` in list order."""
    items = table.select("row_id", F.posexplode(F.split("study_items", r",\s*")).alias("place", "gene"))
    named = items.join(study.select("gene", "direction"), "gene", "left").join(symbols, "gene", "left")
    one = F.struct("place", F.concat_ws("|", "gene", "direction", "symbol").alias("info"))
    # The list was one cell of one row before, so putting it together again is bounded by that row.
    lists = named.groupBy("row_id").agg(F.array_sort(F.collect_list(one)).alias("_l"))
    return table.drop("study_items").join(
        lists.select("row_id", F.array_join(F.transform("_l", lambda x: x["info"]), ";").alias("study_items")), "row_id"
    )


def map_colours(study: DataFrame, gene_terms: DataFrame, gene_kos: DataFrame) -> DataFrame:
    """(study, term, ko, colour): red for up, blue for down, pink without direction; a mixed K entry is yellow.

    Without-direction genes give way to directed ones. On the overview map 01100 down and
    undirected entries are black.
    """
    hits = study.join(gene_terms.select("gene", "term").distinct(), "gene").join(gene_kos.select("gene", "ko").distinct(), "gene")
    overview = F.col("term").endswith("01100")
    direction = F.lower("direction")
    colour = (
        F.when(direction == "up", "red,blue")
        .when(overview, "black")
        .when(direction == "down", "blue,red")
        .otherwise("pink,blue")
    )
    seen = hits.select("study", "term", "ko", colour.alias("colour")).groupBy("study", "term", "ko").agg(
        F.collect_set("colour").alias("_c")  # four colours at most
    )
    directed = F.filter("_c", lambda x: x != "pink,blue")
    final = F.when(F.size(directed) > 1, "yellow").when(F.size(directed) == 1, directed[0]).otherwise("pink,blue")
    return seen.select("study", "term", "ko", final.alias("colour"))


def map_links(colours: DataFrame, base: str) -> DataFrame:
    """One link per study and term with all its K marks; a pathway map has a bounded number of K entries."""
    mark = F.concat(F.lit("/"), "ko", F.lit("%09"), "colour")
    return colours.groupBy("study", "term").agg(
        F.concat(F.lit(base), F.col("term"), F.array_join(F.array_sort(F.collect_list(mark)), "")).alias("link")
    )
