"""Canonical product search, match candidates, decisions and feedback.

Queries are matched as a batch: distinct query texts meet distinct product names
through shared trigrams (an inverted index as an equi join), the number of
shared trigrams and the sizes give the similarity, and names lead to products.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kantar.functions import similarity as M
from kantar.functions.text import normalize_name, parse_quantity
from kantar.operators.pricing import first_by
from kantar.sources.sinks import staged

POOL, MOST = 25, 5


def similar_names(queries: DataFrame, names: DataFrame, floor: float = M.TRIGRAM_FLOOR, inside: bool = False) -> DataFrame:
    """(query, name, similarity): pairs at or over ``floor``; with ``inside`` also names that contain the query.

    ``queries`` has ``query`` and ``names`` has ``name``, normalised and distinct.
    A text inside another shares the trigrams within its words. Queries whose
    words all have fewer than three letters have none; they meet the names that have
    their longest word as one of the one- and two-letter pieces.
    """
    # Texts and names are few bytes and make many pairs, so they are dealt to all tasks; by their size they would go to one.
    deals = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = queries.repartition(deals, "query").select("query", M.trigrams(F.col("query")).alias("t"))
    right = names.repartition(deals, "name").select("name", M.trigrams(F.col("name")).alias("t"))
    met = (
        left.select("query", F.size("t").alias("a"), F.explode("t").alias("g"))
        .join(right.select("name", F.size("t").alias("b"), F.explode("t").alias("g")), "g")
        .groupBy("query", "name", "a", "b")
        .agg(F.count("*").alias("shared"))
        .withColumn("similarity", M.ratio(F.col("shared"), F.col("a"), F.col("b")))
    )
    holds = F.contains(F.col("name"), F.col("query")) & (F.col("query") != "")
    # The float is widened before it is compared, so 7/20 is under 0.35.
    near = F.col("similarity").cast("double") >= F.lit(floor)
    found = met.where(near | holds if inside else near).select("query", "name", "similarity")
    if not inside:
        return found
    short = queries.where(~F.col("query").rlike("[a-z0-9]{3}") & (F.col("query") != ""))
    word = F.array_max(F.transform(F.split("query", " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    piece = lambda n: F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.substr(F.col("name"), i, F.lit(n)))
    pieces = names.where("name <> ''").select("name", F.explode(F.array_distinct(F.concat(piece(1), piece(2)))).alias("piece"))
    apart = short.select("query", word.alias("piece")).join(pieces, "piece").where(holds)
    apart = apart.select("query", "name", M.similarity(F.col("query"), F.col("name")).alias("similarity"))
    return found.unionByName(apart).dropDuplicates(["query", "name"])


def text_candidates(texts: DataFrame, products: DataFrame, pool: int = POOL, limit: int = MOST) -> DataFrame:
    """``candidates`` of each distinct ``raw`` of ``texts``, by ``raw`` instead of ``query_id``: they are those of the text, whoever asks."""
    # Written: else the optimizer finds the first distinct redundant before the second, and every row is normalised.
    asked = staged(texts.select("raw").distinct().select("raw", normalize_name(F.col("raw")).alias("query"), parse_quantity(F.col("raw")).alias("wanted")), "match-texts")
    # Names are few, whatever the number of products, so they are normalised once each.
    normal = products.groupBy("name").agg(F.count("*").alias("held")).withColumn("normal", normalize_name(F.col("name")))
    names = normal.groupBy(F.col("normal").alias("name")).agg(F.least(F.sum("held"), F.lit(pool)).alias("held"))
    pairs = similar_names(asked.select("query").distinct(), names.select("name")).withColumn("name_similarity", M.rounded(F.col("similarity")))
    # Names that come after a whole pool's products of nearer names have none in it. Names alike in similarity share their place, as their products are told apart by name.
    nearer = Window.partitionBy("query").orderBy(F.desc("name_similarity"))
    up_to, alike = F.sum("held").over(nearer), F.sum("held").over(Window.partitionBy("query", "name_similarity"))
    near = pairs.join(names, "name").withColumn("_before", up_to - alike).where(F.col("_before") < pool).select("query", F.col("name").alias("normal"), "name_similarity")
    # A name's products come in a fixed order, so only the first of each name can be in a pool.
    first = lambda df, key, *order: df.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("r") <= pool).drop("r")
    ranked = first(first(products, "name", "canonical_id").join(normal.select("name", "normal"), "name"), "normal", "name", "canonical_id")
    by_text = near.join(ranked, "normal")
    best = Window.partitionBy("query").orderBy(F.desc("name_similarity"), "name", "canonical_id")
    pooled = by_text.withColumn("place", F.row_number().over(best)).where(F.col("place") <= pool)
    hit = asked.join(pooled, "query")
    name = M.name_part(F.col("name_similarity"))
    brand = M.brand_part(F.col("query"), F.col("brand"))
    pack = M.pack_part(F.col("wanted.value"), F.col("wanted.unit"), F.col("quantity_value"), F.col("base_unit"))
    scored = hit.select(
        "raw", "query", "canonical_id", "name", "brand", "wanted", "quantity_value", "base_unit", "name_similarity",
        name.alias("name_score"), brand.alias("brand_score"), pack.alias("pack_score"), M.score(name, brand, pack).alias("score"),
    )
    order = Window.partitionBy("raw").orderBy(F.desc("score"), F.desc("name_similarity"), "name", "canonical_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def candidates(queries: DataFrame, products: DataFrame, pool: int = POOL, limit: int = MOST) -> DataFrame:
    """The best products for each text: a pool by similarity, ranked again by the whole score.

    ``queries``: ``query_id``, ``raw``; ``products``: ``canonical_id``, ``name``,
    ``brand``, ``quantity_value``, ``base_unit``. Pools are scored once a text, not once a query.
    """
    return queries.select("query_id", "raw").join(text_candidates(queries, products, pool, limit), "raw")


def explained(found: DataFrame) -> DataFrame:
    """Candidates with their three sentences."""
    c = F.col
    return found.withColumn(
        "explanations",
        M.explanations(c("name_similarity"), c("brand"), c("brand_score"), c("wanted.value"), c("wanted.unit"), c("quantity_value"), c("base_unit"), c("pack_score")),
    )


def _decided(told: DataFrame, kept: list[str]) -> DataFrame:
    """``kept`` and the decision on ``top_candidate`` and ``top_score``, which are null where nothing was found."""
    status = M.decision(F.col("top_score"))
    return told.select(
        *kept,
        F.col("top_candidate"),
        F.when(status == "AUTO_ACCEPTED", F.col("top_candidate")).alias("matched"),
        F.coalesce("top_score", F.lit(0)).cast("decimal(5,4)").alias("score"),
        status.alias("status"),
        F.lit(False).alias("reused"),
    )


def _top(found: DataFrame, key: str) -> DataFrame:
    return found.where("rank = 1").select(key, F.col("canonical_id").alias("top_candidate"), F.col("score").alias("top_score"))


def decide(queries: DataFrame, found: DataFrame, feedback: DataFrame | None = None) -> DataFrame:
    """One decision per text; a client's own latest feedback on the same normalised text goes first.

    ``feedback``: ``client``, ``query``, ``action``, ``canonical_id``, ``feedback_id``;
    with it ``queries`` has ``client``.
    """
    asked = queries.withColumn("query", normalize_name(F.col("raw")))
    fresh = _decided(asked.join(_top(found, "query_id"), "query_id", "left"), [*queries.columns, "query"])
    return fresh if feedback is None else _answered(fresh, queries.columns, feedback)


def decide_texts(texts: DataFrame, products: DataFrame) -> DataFrame:
    """The decision on each distinct ``raw`` of ``texts``, with its normalised ``query``."""
    asked = texts.select("raw").distinct().withColumn("query", normalize_name(F.col("raw")))
    return _decided(asked.join(_top(text_candidates(texts, products), "raw"), "raw", "left"), ["raw", "query"])


def decide_by_text(queries: DataFrame, told: DataFrame, feedback: DataFrame | None = None) -> DataFrame:
    """``decide`` with the decisions of ``decide_texts``: every text is normalised and decided once, however many ask it."""
    fresh = queries.join(told.withColumnRenamed("raw", "_raw"), F.col("raw").eqNullSafe(F.col("_raw"))).select(*queries.columns, *[n for n in told.columns if n != "raw"])
    return fresh if feedback is None else _answered(fresh, queries.columns, feedback)


def _answered(fresh: DataFrame, columns: list[str], feedback: DataFrame) -> DataFrame:
    last = first_by(feedback, ["client", "query"], [F.desc("feedback_id")]).select("client", "query", F.col("action"), F.col("canonical_id").alias("chosen"))
    both = fresh.join(last, ["client", "query"], "left")
    yes, no = F.col("action") == "CONFIRMED", F.col("action") == "REJECTED"
    reuse = lambda on_yes, on_no, name: F.when(yes, on_yes).when(no, on_no).otherwise(F.col(name)).alias(name)
    return both.select(
        *columns,
        "query",
        reuse(F.col("chosen"), F.lit(None), "top_candidate"),
        reuse(F.col("chosen"), F.lit(None), "matched"),
        reuse(F.lit(1).cast("decimal(5,4)"), F.lit(0).cast("decimal(5,4)"), "score"),
        reuse(F.lit("AUTO_ACCEPTED"), F.lit("UNMATCHED"), "status"),
        F.coalesce(yes | no, F.lit(False)).alias("reused"),
    )


def valid_feedback(feedback: DataFrame, decisions: DataFrame, products: DataFrame) -> DataFrame:
    """Feedback on a decision of the same client or of nobody, with an existing product if confirmed and none if not."""
    owned = feedback.join(decisions.select("decision_id", F.col("client").alias("owner")), "decision_id")
    owned = owned.where(F.col("owner").isNull() | (F.col("owner") == F.col("client")))
    known = owned.join(products.select("canonical_id", F.lit(True).alias("known")), "canonical_id", "left")
    fits = F.when(F.col("action") == "CONFIRMED", F.col("known").isNotNull()).when(F.col("action") == "REJECTED", F.col("canonical_id").isNull()).otherwise(False)
    return known.where(fits).drop("owner", "known")


def search(text: str, products: DataFrame, page: int, size: int) -> DataFrame:
    """A page of canonical products for a text: an exact EAN alone, else by score over all similar or containing names."""
    return search_batch(products.sparkSession.createDataFrame([(0, text)], "query_id long, raw string"), products, page, size)


def search_batch(queries: DataFrame, products: DataFrame, page: int, size: int) -> DataFrame:
    """``search`` for many texts at once, with the number of hits of each."""
    asked = queries.select("query_id", "raw", F.trim("raw").alias("code"), normalize_name(F.col("raw")).alias("query"), parse_quantity(F.col("raw")).alias("wanted"))
    exact = asked.join(products.withColumnRenamed("barcode", "code"), "code").select("query_id", "canonical_id", "name", F.lit(1).cast("decimal(5,4)").alias("score"), F.lit(1).cast("decimal(5,4)").alias("name_similarity"))
    rest = asked.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    known = products.withColumn("normal", normalize_name(F.col("name")))
    pairs = similar_names(rest.select("query").distinct(), known.select(F.col("normal").alias("name")).distinct(), inside=True).withColumnRenamed("name", "normal")
    hit = rest.join(pairs, "query").join(known, "normal").withColumn("name_similarity", M.rounded(F.col("similarity")))
    pack = M.pack_part(F.col("wanted.value"), F.col("wanted.unit"), F.col("quantity_value"), F.col("base_unit"))
    total = M.score(M.name_part(F.col("name_similarity")), M.brand_part(F.col("query"), F.col("brand")), pack)
    every = exact.unionByName(hit.select("query_id", "canonical_id", "name", total.alias("score"), "name_similarity"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("name_similarity"), "name", "canonical_id")
    count = every.groupBy("query_id").agg(F.count("*").alias("total"))
    placed = every.withColumn("place", F.row_number().over(order)).where((F.col("place") > page * size) & (F.col("place") <= (page + 1) * size))
    return placed.join(count, "query_id")


def item_status(items: DataFrame) -> DataFrame:
    """Counts of a list's items by what has to be done with them."""
    exact = F.col("matching_rule") == "EXACT_PRODUCT"
    status = lambda *s: F.col("matching_status").isin(*s)
    return items.groupBy("list_id").agg(
        F.count_if(exact & status("AUTO_MATCHED", "CONFIRMED")).alias("matched_items"),
        F.count_if(exact & status("NEEDS_CONFIRMATION")).alias("to_confirm"),
        F.count_if(exact & status("UNMATCHED")).alias("unmatched_items"),
        F.count_if(~exact).alias("flexible_items"),
        F.count_if(exact & status("PENDING", "NEEDS_CONFIRMATION")).alias("blocking_items"),
    )

