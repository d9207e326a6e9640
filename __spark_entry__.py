
from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable
from functools import cache, reduce
from importlib.util import find_spec

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.config import DEFAULT_WEIGHTS, INTERACTION_PRIORITY, RunConfig
from shelfwise import session
from shelfwise.functions.vectors import format_vector, inner_product, parse_vector, split_parsable
from shelfwise.operators import catalog, factors, interactions, similarity, sinks, upsert
from shelfwise.operators.evaluation import regression_metrics
from shelfwise.operators.ranking import top_n_unseen
from shelfwise.plans import ledger, recommend
from shelfwise.session import lookup_join
from shelfwise.sources import files, snapshot, tables, testdata

# Only the absence of the package or module is passed over: whatever else fails in them is an error.
corpus_queries = corpus_pipeline = None
if find_spec("shelfwise.llm") is not None and find_spec("shelfwise.llm.queries") is not None:
    from shelfwise.llm import queries as corpus_queries
if corpus_queries and find_spec("corpus_pipeline") is not None:
    import corpus_pipeline

DOMAIN = "img.example.com"
CONFIG = RunConfig(interaction_thresholds=testdata.LOW_TIERS, split_test_data=True, test_ratio=0.1, top_n=10)


# --- shared steps -----------------------------------------------------------------------------------------


def _interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.build_interactions(
        testdata.event_logs(spark, sf_dir), testdata.EVENTS_AS_OF, testdata.EVENTS_DAYS, testdata.LOW_TIERS
    )


def _order_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.build_interactions(
        testdata.order_logs(spark, sf_dir), testdata.ORDERS_AS_OF, testdata.ORDERS_DAYS, testdata.LOW_TIERS
    )


@cache
def _prepared(spark: SparkSession, sf_dir: str) -> recommend.Prepared:
    return recommend.prepare(testdata.event_logs(spark, sf_dir), CONFIG, testdata.EVENTS_AS_OF)


@cache
def _trained(spark: SparkSession, sf_dir: str) -> recommend.Trained:
    return recommend.train(_prepared(spark, sf_dir).ratings, CONFIG)


def _embedding_factors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Factors with known values: every embedding is a candidate, numbered as an item, and members take embeddings
    by the remainder of their number. Also the seen pairs."""
    prepared = _prepared(spark, sf_dir)
    vectors = testdata.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("int").alias("item_idx"), F.col("embedding").alias("features")
    )
    members = prepared.users.df.select("user_idx", F.pmod("user_idx", F.lit(vectors.count())).alias("item_idx"))
    users = members.join(vectors, "item_idx").select("user_idx", "features")
    return users, vectors, prepared.ratings.select("user_idx", "item_idx")


def _product_factors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``_embedding_factors``, but the candidates are the products, which take embeddings by remainder too."""
    users, vectors, seen = _embedding_factors(spark, sf_dir)
    n = F.lit(vectors.count())
    products = _prepared(spark, sf_dir).items.df.select("item_idx", F.pmod("item_idx", n).alias("_vec"))
    vectors = vectors.withColumnRenamed("item_idx", "_vec")
    return users, products.join(vectors, "_vec").select("item_idx", "features"), seen


# --- interactions, indices, ratings -----------------------------------------------------------------------


def q_interactions(spark, sf_dir):
    return _interactions(spark, sf_dir)


def q_order_interactions(spark, sf_dir):
    return _order_interactions(spark, sf_dir)


def q_interactions_ordered(spark, sf_dir):
    return interactions.ordered_interactions(_interactions(spark, sf_dir))


def q_interaction_stats(spark, sf_dir):
    return interactions.interaction_stats(_interactions(spark, sf_dir))


def q_interaction_type_counts(spark, sf_dir):
    return interactions.interaction_type_counts(_interactions(spark, sf_dir))


def q_order_interaction_type_counts(spark, sf_dir):
    return interactions.interaction_type_counts(_order_interactions(spark, sf_dir))


def q_large_purchases(spark, sf_dir):
    return interactions.purchases(
        testdata.large_purchases(spark, sf_dir), testdata.ORDERS_AS_OF, testdata.ORDERS_DAYS
    )


def q_user_index(spark, sf_dir):
    return _prepared(spark, sf_dir).users.df.select("member_id", "user_idx")


def q_item_index(spark, sf_dir):
    return _prepared(spark, sf_dir).items.df.select("product_id", "item_idx")


def q_ratings(spark, sf_dir):
    return _prepared(spark, sf_dir).ratings


def q_split_test(spark, sf_dir):
    return _trained(spark, sf_dir).split.test


def q_split_train(spark, sf_dir):
    return _trained(spark, sf_dir).split.train


def q_split_sizes(spark, sf_dir):
    split = _trained(spark, sf_dir).split
    return split.train.agg(F.count(F.lit(1)).alias("n")).select(F.lit("train").alias("part"), "n").unionByName(
        split.test.agg(F.count(F.lit(1)).alias("n")).select(F.lit("test").alias("part"), "n")
    )


# --- model ------------------------------------------------------------------------------------------------


def q_eval_metrics(spark, sf_dir):
    """Predict test rows by the item's mean train rating; an item absent from train gives no prediction."""
    split = _trained(spark, sf_dir).split
    items = _prepared(spark, sf_dir).items
    means = split.train.groupBy("item_idx").agg(F.avg("rating").alias("prediction"))
    dim = items.df.select("item_idx", "n_rows").join(means, "item_idx", "left")
    predicted = lookup_join(split.test, dim, ["item_idx"], "n_rows", items.size, items.total_rows)
    metrics = regression_metrics(predicted)
    return metrics.select("n", F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"))


def q_als_dims(spark, sf_dir):
    return factors.factor_dims(_trained(spark, sf_dir).model)


def q_als_recommendations(spark, sf_dir):
    recs = recommend.recommend(_prepared(spark, sf_dir), _trained(spark, sf_dir), CONFIG.top_n)
    return recs.select("member_id", "product_id", "rank", F.round("score", 6).alias("score"))


def q_als_topn_counts(spark, sf_dir):
    recs = recommend.recommend(_prepared(spark, sf_dir), _trained(spark, sf_dir), CONFIG.top_n)
    return recs.groupBy("user_idx").agg(F.count(F.lit(1)).alias("n"))


def q_als_metrics(spark, sf_dir):
    return recommend.evaluate(_prepared(spark, sf_dir), _trained(spark, sf_dir))


def q_als_recommendation_checks(spark, sf_dir):
    """Per member of the fitted model: products recommended, and what must not be: seen products, gaps in the ranks,
    scores out of order, and scores that differ from those of the library's own ranking at the same place.

    The library ranks with seen products, so it is asked for as many more as one member has seen at most.
    """
    trained = _trained(spark, sf_dir)
    seen = trained.split.train.select("user_idx", "item_idx").distinct()
    most = seen.groupBy("user_idx").count().agg(F.max("count")).first()[0]
    recs = recommend.recommend(_prepared(spark, sf_dir), trained, CONFIG.top_n).select("user_idx", "item_idx", "rank", "score")
    hit = seen.withColumn("seen", F.lit(1))
    by_rank = Window.partitionBy("user_idx").orderBy("rank")
    own = recs.join(hit, ["user_idx", "item_idx"], "left").withColumn("before", F.lag("score").over(by_rank))
    other = trained.model.recommendForAllUsers(CONFIG.top_n + most).select("user_idx", F.explode("recommendations").alias("r"))
    other = other.select("user_idx", F.col("r.item_idx").alias("item_idx"), F.col("r.rating").alias("other")).join(
        seen, ["user_idx", "item_idx"], "left_anti"
    )
    by_score = Window.partitionBy("user_idx").orderBy(F.col("other").desc())
    other = other.withColumn("rank", F.row_number().over(by_score)).select("user_idx", "rank", "other")
    return own.join(other, ["user_idx", "rank"], "left").groupBy("user_idx").agg(
        F.count(F.lit(1)).alias("n"), F.count("seen").alias("n_seen"),
        (F.max("rank") - F.count(F.lit(1))).cast("bigint").alias("rank_gaps"),
        F.count_if(F.col("score") > F.col("before")).alias("order_breaks"),
        F.count_if(F.coalesce(F.abs(F.col("score") - F.col("other")) > 1e-4, F.lit(True))).alias("n_off"),
    )


def q_als_metric_checks(spark, sf_dir):
    """Held-out rows, and those where the stored factors and the model's own prediction disagree."""
    prepared, trained = _prepared(spark, sf_dir), _trained(spark, sf_dir)
    stored = factors.predict_stored(
        trained.user_factors, trained.item_factors, trained.split.test, prepared.users, prepared.items
    )
    own = factors.predict(trained.model, stored.withColumnRenamed("prediction", "stored"))
    own = own.withColumn("own", F.nanvl(F.col("prediction").cast("double"), F.lit(None).cast("double")))
    same = F.col("stored").eqNullSafe(F.col("own")) | (F.abs(F.col("stored") - F.col("own")) <= 1e-4)
    return own.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(same, F.lit(False))).alias("n_off"))


def q_run_report(spark, sf_dir):
    """Counts in the report of a whole run on the events."""
    report = recommend.run(testdata.event_logs(spark, sf_dir), CONFIG, testdata.EVENTS_AS_OF).report
    counts = [*report["interactions"].values(), *report["split"].values(), report["users_recommended"]]
    return spark.createDataFrame(
        [tuple(int(x) for x in counts)],
        "n_interactions bigint, n_users bigint, n_items bigint, n_train bigint, n_test bigint, n_recommended bigint",
    )


def q_interactions_snapshot(spark, sf_dir):
    """Interactions that went through a snapshot: built and written by the first reader, read by the second."""
    root = f"{session.shared_root(spark)}/snapshots-{uuid.uuid4().hex}"
    logs = testdata.event_logs(spark, sf_dir)
    for _ in range(2):
        prepared = recommend.prepare(logs, CONFIG, testdata.EVENTS_AS_OF, root)
    return prepared.interactions


def q_snapshot_hits_and_misses(spark, sf_dir):
    """The snapshot of stored logs is built, found again, and built anew on the same day when files were added."""
    root = f"{session.shared_root(spark)}/growing-{uuid.uuid4().hex}"
    logs, late, steps = testdata.event_logs(spark, sf_dir), F.col("created_at") >= "2024-01-26", []
    for step, rows in (("first", ~late), ("again", None), ("files added", late)):
        if rows is not None:
            for name in tables.LOG_TABLES:
                getattr(logs, name).where(rows).write.mode("append").parquet(f"{root}/logs/{name}")
        stored = tables.BehaviourLogs.from_files(spark, f"{root}/logs")
        path = snapshot.snapshot_path(f"{root}/snapshots", CONFIG, testdata.EVENTS_AS_OF, stored.identity())
        hit = snapshot.is_complete(spark, path)
        found = recommend.prepare(stored, CONFIG, testdata.EVENTS_AS_OF, f"{root}/snapshots").interactions
        steps.append((step, hit, found.count()))
    return spark.createDataFrame(steps, "step string, hit boolean, n bigint")


def q_shipped_thresholds(spark, sf_dir):
    """Interactions by type on the orders, with tiers at 1, 4 and 7 as given in flat settings."""
    flat = {f"{kind}{i + 1}": n for kind in ("view", "impression") for i, n in enumerate((1, 4, 7))}
    cfg = RunConfig.from_dict({"days": testdata.ORDERS_DAYS, "interaction_thresholds": flat})
    found = interactions.build_interactions(
        testdata.order_logs(spark, sf_dir), testdata.ORDERS_AS_OF, cfg.days, cfg.interaction_thresholds
    )
    return interactions.interaction_type_counts(found)


def q_als_block_loads(spark, sf_dir):
    """What the largest tasks of the fit hold, known before it."""
    return factors.block_loads(_trained(spark, sf_dir).split.train, CONFIG.als_blocks)


def q_factors_export(spark, sf_dir):
    """Exported factor rows per side: how many, how long, and how many do not follow the one before by index."""
    trained = _trained(spark, sf_dir)
    root = f"{session.shared_root(spark)}/factors-{uuid.uuid4().hex}"

    def checked(side: str, rows: DataFrame) -> DataFrame:
        rows = factors.ordered_factors(rows).withColumnRenamed(rows.columns[0], "idx")
        rows.select("idx", F.size("features").alias("dims"), F.spark_partition_id().alias("part"),
                    F.monotonically_increasing_id().alias("at")).write.parquet(f"{root}/{side}")
        stored = spark.read.parquet(f"{root}/{side}")
        inner = Window.partitionBy("part").orderBy("at")
        late = F.coalesce(F.col("idx") <= F.lag("idx").over(inner), F.lit(False)).cast("bigint")
        parts = stored.withColumn("late", late).groupBy("part").agg(
            F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("late").alias("late"),
            F.max("dims").alias("dims"),
        )
        # One row per written partition from here on.
        between = F.coalesce(F.col("lo") <= F.lag("hi").over(Window.orderBy("part")), F.lit(False)).cast("bigint")
        return parts.withColumn("between", between).agg(
            F.lit(side).alias("side"), F.sum("n").alias("n"), F.max("dims").alias("dims"),
            F.sum(F.col("late") + F.col("between")).alias("n_out_of_order"),
        )

    return checked("user", trained.user_factors).unionByName(checked("item", trained.item_factors))


def q_run_ledger(spark, sf_dir):
    """Two runs entered in a ledger: one saves its rows to a table, the other's target cannot be written."""
    root = f"{session.shared_root(spark)}/ledger-{uuid.uuid4().hex}"
    files.create_text(spark, f"{root}/in-the-way", "a file where a folder is wanted")
    cfg = dataclasses.replace(CONFIG, save_to_db=True, db_type="parquet")
    for target in (f"{root}/saved", f"{root}/in-the-way/saved"):
        recommend.run(
            testdata.event_logs(spark, sf_dir), cfg, testdata.EVENTS_AS_OF, save_to={"path": target},
            ledger_path=f"{root}/runs",
        )
    rows = ledger.runs(spark, f"{root}/runs")
    top_n = F.get_json_object("settings", "$.top_n").cast("int").alias("top_n")
    return rows.select("status", "mode", top_n, *ledger.COUNTS, F.col("error").isNotNull().alias("has_error"))


def q_saved_recommendations(spark, sf_dir):
    """Recommendations appended to a stored table and read back."""
    path = f"{session.shared_root(spark)}/saved-{uuid.uuid4().hex}"
    sinks.save_recommendations(_named(spark, sf_dir), "parquet", testdata.EVENTS_AS_OF, path=path)
    return spark.read.parquet(path).select("member_id", "product_ids")


def q_als_normal_equations(spark, sf_dir):
    """How far the trained user factors are from solving their least-squares problem, which they must.

    For every user: sum over rated items of (predicted - rating) * v, plus lambda * n * u, is zero.
    """
    trained = _trained(spark, sf_dir)
    rows = (
        trained.split.train.join(trained.item_factors.withColumnRenamed("features", "v"), "item_idx")
        .join(trained.user_factors.withColumnRenamed("features", "u"), "user_idx")
        .withColumn("e", inner_product(F.col("u"), F.col("v")) - F.col("rating"))
    )
    n = CONFIG.rank
    sums = [F.sum(F.col("e") * F.col("v")[i] + F.lit(CONFIG.reg_param) * F.col("u")[i]) for i in range(n)]
    per_user = rows.groupBy("user_idx").agg(F.greatest(*[F.abs(s) for s in sums]).alias("gap"))
    return per_user.agg(
        F.count(F.lit(1)).alias("n_users"), F.count_if(F.col("gap") > 1e-3).alias("n_users_off")
    )


# --- ranking ----------------------------------------------------------------------------------------------


def _masked(spark, sf_dir, n, mode):
    users, items, seen = _embedding_factors(spark, sf_dir)
    return top_n_unseen(users, items, seen, n, mode)


def q_topn_masked_strict(spark, sf_dir):
    return _masked(spark, sf_dir, 10, "strict").withColumn("score", F.round("score", 6))


def q_topn_masked_pad(spark, sf_dir):
    return _masked(spark, sf_dir, 100, "pad").select("user_idx", "item_idx", "rank", F.round("score", 6).alias("score"))


def _named(spark, sf_dir):
    users, items, seen = _product_factors(spark, sf_dir)
    prepared = _prepared(spark, sf_dir)
    return top_n_unseen(users, items, seen, 10, "strict", prepared.users, prepared.items)


def q_results_wide(spark, sf_dir):
    return sinks.wide_results(_named(spark, sf_dir))


def q_recommendation_rows(spark, sf_dir):
    return sinks.recommendation_rows(_named(spark, sf_dir), testdata.EVENTS_AS_OF).select(
        "member_id", "product_ids", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at")
    )


def q_recommended_ids(spark, sf_dir):
    """Index to id on a finished result, the other way round from joining the factor tables."""
    prepared = _prepared(spark, sf_dir)
    recs = top_n_unseen(*_product_factors(spark, sf_dir), 10, "strict").select("user_idx", "item_idx", "rank")
    return prepared.items.attach_id(prepared.users.attach_id(recs)).select("member_id", "product_id", "rank")


# --- similarity -------------------------------------------------------------------------------------------


def q_similar_products(spark, sf_dir):
    similar = similarity.similar_products(testdata.product_embeddings(spark, sf_dir), top_k=10)
    return similar.withColumn("distance", F.round("distance", 6))


def q_similar_lists(spark, sf_dir):
    similar = similarity.similar_products(testdata.product_embeddings(spark, sf_dir), top_k=100)
    lists = similarity.similar_lists(similar)
    return lists.select("product_id", sinks.join_ids(F.col("similar_ids")).alias("similar_ids"))


def q_similar_by_id(spark, sf_dir):
    similar = similarity.similar_to(testdata.product_embeddings(spark, sf_dir), 7, 20)
    return similar.withColumn("distance", F.round("distance", 6))


def q_search_by_vector(spark, sf_dir):
    products = testdata.product_embeddings(spark, sf_dir)
    found = similarity.search_by_vector(products, similarity.product_vector(products, 7), 20, [7, 8, 9])
    return found.withColumn("distance", F.round("distance", 6))


def q_search_by_vectors(spark, sf_dir):
    products = testdata.product_embeddings(spark, sf_dir)
    queries = products.select(F.col("id").alias("query_id"), F.col("image_vector").alias("vector"))
    sold_out = products.where("status = 'SOLD_OUT'").select("id")
    found = similarity.search_by_vectors(products, queries, 20, sold_out)
    return found.withColumn("distance", F.round("distance", 6))


def _vector_summary(df: DataFrame) -> DataFrame:
    total = F.aggregate("image_vector", F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double"))
    return df.withColumns(
        {"dims": F.size("image_vector").cast("bigint"), "total": F.round(total, 5)}
    ).drop("image_vector")


def q_product_vectors(spark, sf_dir):
    products = testdata.product_embeddings(spark, sf_dir)
    wanted = testdata.product_catalog(spark, sf_dir).select("id")
    return _vector_summary(similarity.product_vectors(products, wanted))


def q_vector_text_roundtrip(spark, sf_dir):
    products = testdata.product_embeddings(spark, sf_dir)
    text = format_vector(F.col("image_vector"))
    return _vector_summary(products.select("id", parse_vector(text).alias("image_vector")))


def q_embeddings_upsert(spark, sf_dir):
    """Sold-out products come back on sale with a negated vector, label 3 is then hidden, label 5 is copied
    to new ids; a sold-out product of label 3 is updated twice."""
    products = testdata.product_embeddings(spark, sf_dir)
    negated = F.transform("image_vector", lambda x: -x)
    back = products.where("status = 'SOLD_OUT'").withColumns(
        {"status": F.lit("SALE"), "image_vector": negated, "seq": F.lit(1)}
    )
    hidden = products.where("primary_category_id = 3").withColumns({"status": F.lit("HIDDEN"), "seq": F.lit(2)})
    copies = products.where("primary_category_id = 5").withColumns({"id": -1 - F.col("id"), "seq": F.lit(3)})
    updates = back.unionByName(hidden).unionByName(copies)
    path = f"{session.shared_root(spark)}/embeddings-{uuid.uuid4().hex}"
    upsert.write_embeddings(products, path)
    upsert.upsert_stored(spark, path, updates)
    return _vector_summary(upsert.read_embeddings(spark, path))


def q_vector_quarantine(spark, sf_dir):
    """Vectors as text, some with an element that is no number, parted into good ones and those put aside."""
    products = testdata.product_embeddings(spark, sf_dir)
    text = format_vector(F.col("image_vector"))
    broken = F.when(F.col("id") % 7 == 3, F.regexp_replace(text, ",", ",x")).otherwise(text)
    good, aside = split_parsable(products.select("id", broken.alias("t")), "t", "v")
    return good.select("id", F.lit("good").alias("part")).unionByName(aside.select("id", F.lit("aside").alias("part")))


def q_embeddings_versions(spark, sf_dir):
    """A stored table read back version by version: as written, after an upsert, after a second one, and merged."""
    products = testdata.product_embeddings(spark, sf_dir)
    hidden = products.where("primary_category_id = 3").withColumns({"status": F.lit("HIDDEN"), "seq": F.lit(1)})
    copies = products.where("primary_category_id IN (3, 5)").withColumns({"id": -1 - F.col("id"), "seq": F.lit(1)})
    path = f"{session.shared_root(spark)}/embeddings-{uuid.uuid4().hex}"
    upsert.write_embeddings(products, path)
    for batch in (hidden, copies):
        upsert.upsert_stored(spark, path, batch)
    upsert.compact_stored(spark, path)
    seen = [
        upsert.read_embeddings(spark, path, v).agg(
            F.lit(v).alias("version"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "HIDDEN").alias("n_hidden"),
            F.count_if(F.col("id") < 0).alias("n_copies"),
        )
        for v in (1, 2, 3, 4)
    ]
    return reduce(DataFrame.unionByName, seen)


def _refused(act: Callable[[], object]) -> bool:
    try:
        act()
    except (ValueError, PySparkException):
        return True
    return False


def q_refused_inputs(spark, sf_dir):
    """Batches and targets that must be refused whole, with the rows they were made of; the last one is in order."""
    products = testdata.product_embeddings(spark, sf_dir)
    batch = products.withColumn("seq", F.lit(1))
    third, vector = F.col("id") % 3 == 0, F.col("image_vector")
    path = f"{session.shared_root(spark)}/refusals-{uuid.uuid4().hex}"
    upsert.write_embeddings(products, path)
    longer = F.when(third, F.concat(vector, F.array(F.lit(1.0).cast("float")))).otherwise(vector)
    nan = F.when(third, F.transform(vector, lambda x: x * float("nan"))).otherwise(vector)
    batches = {
        "no id": batch.withColumn("id", F.when(~third, F.col("id"))),
        "no vector": batch.withColumn("image_vector", F.when(~third, vector)),
        "element no number": batch.withColumn("image_vector", nan),
        "other length": batch.withColumn("image_vector", longer),
        "repeated seq": batch.unionByName(batch.where(third)),
        "in order": batch,
    }
    rows = [(name, _refused(lambda b=b: upsert.upsert_stored(spark, path, b)), b.count()) for name, b in batches.items()]
    mixed = products.withColumn("image_vector", longer)
    search = lambda: similarity.search_by_vectors(mixed, mixed.select(F.col("id").alias("query_id"), F.col("image_vector").alias("vector"))).count()
    rows.append(("search over other lengths", _refused(search), products.count()))
    save = lambda: sinks.save_recommendations(_named(spark, sf_dir), "sqlite", url="jdbc:sqlite:x")
    rows.append(("unknown target", _refused(save), products.count()))
    return spark.createDataFrame(rows, "input string, refused boolean, n bigint")


def q_set_aside_rows(spark, sf_dir):
    """Rows of stored logs that do or do not fit the declared types, by file format; text times need a declared cast."""
    root = f"{session.shared_root(spark)}/typed-{uuid.uuid4().hex}"
    logs = testdata.event_logs(spark, sf_dir)
    time = F.col("created_at").cast("string")
    broken = F.when(F.col("member_id").cast("bigint") % 11 == 3, F.concat(F.lit("at "), time)).otherwise(time)
    logs.action_log.withColumn("created_at", broken).write.parquet(f"{root}/action_log")
    number = F.when(F.col("id") % 13 == 5, F.concat(F.lit("x"), F.col("id"))).otherwise(F.col("id").cast("string"))
    views = logs.product_view.withColumns({"id": number, "created_at": time})
    views.write.option("header", True).csv(f"{root}/product_view")
    rows = []
    for fmt, name, casts in (("parquet", "action_log", {"created_at": "cast"}), ("csv", "product_view", {})):
        for part, df in zip(("good", "aside"), tables.read_parted(spark, f"{root}/{name}", name, fmt, casts)):
            rows.append((fmt, part, df.count()))
    refused = _refused(lambda: tables.read_table(spark, f"{root}/action_log", "action_log"))
    rows.append(("parquet", "undeclared" if refused else "taken", 0))
    return spark.createDataFrame(rows, "format string, part string, n bigint")


def q_no_condition_no_products(spark, sf_dir):
    """Counts of a page without a condition, which has no rows, and of one with a condition that always holds."""
    products = testdata.product_catalog(spark, sf_dir)
    n = F.count(F.lit(1)).alias("n")
    without, every = catalog.product_ids(products).agg(n), catalog.product_ids(products, F.lit(True)).agg(n)
    return without.select(F.lit("none").alias("condition"), "n").unionByName(every.select(F.lit("true").alias("condition"), "n"))


# --- catalog ----------------------------------------------------------------------------------------------


def q_product_page(spark, sf_dir):
    return catalog.product_page(testdata.product_catalog(spark, sf_dir), "status = 'SALE'", 500, 1, DOMAIN)


def q_product_urls(spark, sf_dir):
    return catalog.product_urls(testdata.product_catalog(spark, sf_dir), F.lit(True), domain=DOMAIN)


def q_product_ids(spark, sf_dir):
    return catalog.product_ids(testdata.product_catalog(spark, sf_dir), F.col("secondary_category_id") >= 25)


def q_all_product_ids(spark, sf_dir):
    return catalog.all_product_ids(testdata.product_embeddings(spark, sf_dir))


def q_product_links(spark, sf_dir):
    wanted = testdata.product_embeddings(spark, sf_dir).select("id")
    return catalog.product_links(testdata.product_catalog(spark, sf_dir), wanted, DOMAIN)


def _on_sale(spark, sf_dir):
    return testdata.product_catalog(spark, sf_dir).where("status = 'SALE'")


def q_product_page_after(spark, sf_dir):
    """The second page of a sweep, from the last id of the first."""
    rows = _on_sale(spark, sf_dir).select("id", "secondary_category_id")
    last = catalog.page_after(rows, None, 40).agg(F.max("id")).first()[0]
    return catalog.page_after(rows, last, 40)


def q_product_page_directory(spark, sf_dir):
    return catalog.page_directory(_on_sale(spark, sf_dir), 40)


def q_product_page_deep(spark, sf_dir):
    """The last page of a sweep, as a key range out of the directory."""
    directory = catalog.page_directory(_on_sale(spark, sf_dir), 40)
    last = directory.agg(F.max("batch_no")).first()[0]
    products = testdata.product_catalog(spark, sf_dir)
    return catalog.product_page(products, "status = 'SALE'", batch_no=last, domain=DOMAIN, directory=directory)


def q_product_page_numbers(spark, sf_dir):
    return catalog.page_numbers(testdata.product_catalog(spark, sf_dir).select("id", "status"), 500)


def entry(spark: SparkSession) -> DataFrame:
    """Whole run on the events: interactions, ratings, split, ALS, top-n unseen products per member."""
    sf_dir = "/root/testdata/sf0.001"
    cfg = dataclasses.replace(CONFIG, top_n=100)
    result = recommend.run(testdata.event_logs(spark, sf_dir), cfg, testdata.EVENTS_AS_OF)
    return result.recommendations.select("member_id", "product_id", "rank", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name[2:]: fn for name, fn in globals().items() if name.startswith("q_")}
    if corpus_queries:
        found |= corpus_queries.queries()
    if corpus_pipeline:
        found["pipeline"] = corpus_pipeline.run
    return found


# --- SQL twins --------------------------------------------------------------------------------------------

_EVENT_LOGS = """
  k AS (SELECT event_id, ts, CAST(user_id AS VARCHAR) AS member, props->>'$.k' AS product, event_type FROM events),
  product_view AS (SELECT event_id AS id, member AS member_id, product AS product_id, ts AS created_at
                   FROM k WHERE event_type = 'view'),
  product_impression AS (SELECT member AS member_id, product AS product_id, ts AS created_at
                         FROM k WHERE event_type = 'click'),
  action_log AS (SELECT member AS member_id, product AS product_id, ts AS created_at,
                        CASE event_type WHEN 'signup' THEN 'LikedEvent' WHEN 'error' THEN 'CartItemPutEvent'
                             ELSE event_type END AS event_name FROM k),
  purchased_product AS (SELECT member AS customer_id, product AS archived_id, ts AS created_at
                        FROM k WHERE event_type = 'purchase'),
  since AS (SELECT TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY AS t)"""

_ORDER_LOGS = """
  l AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  product_view AS (SELECT l_orderkey * 8 + l_linenumber AS id, o_custkey AS member_id, l_suppkey AS product_id,
                          l_shipdate AS created_at FROM l),
  product_impression AS (SELECT o_custkey AS member_id, l_suppkey AS product_id, l_shipdate AS created_at
                         FROM l WHERE l_returnflag = 'R'),
  action_log AS (SELECT o_custkey AS member_id, l_suppkey AS product_id, l_shipdate AS created_at,
                        CASE l_returnflag WHEN 'A' THEN 'LikedEvent' WHEN 'N' THEN 'CartItemPutEvent'
                             ELSE 'Returned' END AS event_name FROM l),
  purchased_product AS (SELECT o_custkey AS customer_id, l_suppkey AS archived_id, l_shipdate AS created_at
                        FROM l WHERE l_linestatus = 'F'),
  since AS (SELECT TIMESTAMP '2002-01-01 00:00:00' - INTERVAL 4000 DAY AS t)"""

_INTERACTIONS = """,
  views AS (SELECT TRY_CAST(member_id AS BIGINT) AS member_id, TRY_CAST(product_id AS BIGINT) AS product_id,
                   COUNT(DISTINCT id) AS n
            FROM product_view, since WHERE created_at >= t GROUP BY 1, 2),
  impressions AS (SELECT TRY_CAST(member_id AS BIGINT) AS member_id, TRY_CAST(product_id AS BIGINT) AS product_id,
                         COUNT(*) AS n
                  FROM product_impression, since WHERE created_at >= t GROUP BY 1, 2),
  unioned AS (
    SELECT member_id, product_id, CASE WHEN n >= 3 THEN 'view3' WHEN n >= 2 THEN 'view2'
                                       WHEN n >= 1 THEN 'view1' END AS interaction_type FROM views
    UNION ALL
    SELECT member_id, product_id, CASE WHEN n >= 3 THEN 'impression3' WHEN n >= 2 THEN 'impression2'
                                       WHEN n >= 1 THEN 'impression1' END FROM impressions
    UNION ALL
    SELECT TRY_CAST(member_id AS BIGINT), TRY_CAST(product_id AS BIGINT), 'like'
    FROM action_log, since WHERE event_name = 'LikedEvent' AND created_at >= t
    UNION ALL
    SELECT TRY_CAST(member_id AS BIGINT), TRY_CAST(product_id AS BIGINT), 'cart'
    FROM action_log, since WHERE event_name = 'CartItemPutEvent' AND created_at >= t
    UNION ALL
    SELECT TRY_CAST(customer_id AS BIGINT), TRY_CAST(archived_id AS BIGINT), 'purchase'
    FROM purchased_product, since WHERE created_at >= t),
  interactions AS (SELECT DISTINCT member_id, product_id, interaction_type FROM unioned
                   WHERE member_id IS NOT NULL AND product_id IS NOT NULL AND interaction_type IS NOT NULL)"""

_RATINGS = f""",
  users AS (SELECT member_id, CAST(row_number() OVER (ORDER BY member_id) - 1 AS INTEGER) AS user_idx
            FROM (SELECT DISTINCT member_id FROM interactions)),
  items AS (SELECT product_id, CAST(row_number() OVER (ORDER BY m, product_id) - 1 AS INTEGER) AS item_idx
            FROM (SELECT product_id, min(member_id) AS m FROM interactions GROUP BY 1)),
  weights(interaction_type, rating) AS (
    VALUES {", ".join(f"('{t}', CAST({w} AS DOUBLE))" for t, w in DEFAULT_WEIGHTS.items())}),
  ratings AS (SELECT user_idx, item_idx, interaction_type, rating FROM interactions
              JOIN users USING (member_id) JOIN items USING (product_id) JOIN weights USING (interaction_type))"""

_SPLIT = """,
  numbered AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', user_idx, item_idx, interaction_type, '42')),
                                            user_idx, item_idx, interaction_type) AS rn,
                      count(*) OVER () AS total FROM ratings),
  test AS (SELECT user_idx, item_idx, interaction_type, rating FROM numbered WHERE rn <= ceil(0.1 * total)),
  train AS (SELECT user_idx, item_idx, interaction_type, rating FROM numbered WHERE rn > ceil(0.1 * total))"""

_CANDIDATES = """,
  size AS (SELECT count(*) AS n FROM embeddings),
  candidates AS (SELECT CAST(vec_id AS INTEGER) AS item_idx, embedding AS v FROM embeddings)"""

_CANDIDATE_PRODUCTS = """,
  size AS (SELECT count(*) AS n FROM embeddings),
  candidates AS (SELECT item_idx, embedding AS v FROM items, size JOIN embeddings ON vec_id = item_idx % n)"""

_MASKED = """,
  scored AS (SELECT user_idx, item_idx,
                    list_inner_product(u.embedding::DOUBLE[], c.v::DOUBLE[]) AS score,
                    EXISTS (SELECT 1 FROM ratings r
                            WHERE r.user_idx = users.user_idx AND r.item_idx = c.item_idx) AS seen
             FROM users CROSS JOIN size JOIN embeddings u ON u.vec_id = user_idx % n CROSS JOIN candidates c),
  strict AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_idx ORDER BY score DESC, item_idx) AS INTEGER) AS rank
             FROM scored WHERE NOT seen),
  padded AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_idx
                            ORDER BY seen, CASE WHEN seen THEN NULL ELSE score END DESC, item_idx) AS INTEGER) AS rank
             FROM scored)"""

_PRODUCTS = """
  products AS (SELECT vec_id AS id, embedding AS image_vector,
                      CASE WHEN embedding[1] < 0 AND embedding[2] < 0 THEN 'SOLD_OUT' ELSE 'SALE' END AS status,
                      label AS primary_category_id,
                      CAST(embedding[3] > 0 AS INTEGER) + CAST(embedding[4] > 0 AS INTEGER) AS secondary_category_id
               FROM embeddings)"""

_CATALOG = f"""
  catalog AS (SELECT p_partkey AS id,
                     CASE WHEN p_type IN ('PROMO', 'SMALL') THEN NULL
                          ELSE 'https://{DOMAIN}/' || p_partkey || '.jpg' END AS image_url,
                     CASE WHEN p_retailprice < 950 THEN 'SALE' ELSE 'SOLD_OUT' END AS status,
                     CAST(substr(p_brand, 7) AS INTEGER) AS primary_category_id,
                     p_size AS secondary_category_id FROM part)"""

_SIMILAR = """,
  pairs AS (SELECT p1.id AS product_id, p2.id AS similar_id,
                   -list_inner_product(p1.image_vector::DOUBLE[], p2.image_vector::DOUBLE[]) AS d
            FROM products p1 JOIN products p2
              ON p1.primary_category_id = p2.primary_category_id
             AND p1.secondary_category_id = p2.secondary_category_id AND p1.id <> p2.id
            WHERE p2.status = 'SALE'),
  ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY product_id ORDER BY d, similar_id) AS INTEGER) AS rank
             FROM pairs)"""

_SUMMARY = "len(image_vector) AS dims, round(list_sum(image_vector::DOUBLE[]), 5) AS total"


def oracle_sql() -> dict[str, str]:
    base = f"WITH {_EVENT_LOGS}{_INTERACTIONS}"
    orders = f"WITH {_ORDER_LOGS}{_INTERACTIONS}"
    rated = base + _RATINGS
    split = rated + _SPLIT
    masked = rated + _CANDIDATES + _MASKED
    masked_products = rated + _CANDIDATE_PRODUCTS + _MASKED
    products = f"WITH {_PRODUCTS}"
    parts = f"WITH {_CATALOG}"
    shipped = orders.replace("n >= 3", "n >= 7").replace("n >= 2", "n >= 4")
    early = base.replace("FROM events)", "FROM events WHERE ts < TIMESTAMP '2024-01-26 00:00:00')")
    counted = "SELECT count(*) FROM interactions"
    recommended = """(SELECT count(*) FROM (SELECT user_idx FROM train GROUP BY 1 HAVING count(DISTINCT item_idx)
              < (SELECT count(DISTINCT item_idx) FROM train)))"""

    def loads(side: str, idx: str) -> str:
        return f"""SELECT '{side}' AS side, CAST({CONFIG.als_blocks} AS BIGINT) AS blocks, CAST(sum(ids) AS BIGINT) AS n_ids,
            max(most) AS most_rows_of_id, CAST(max(rows_) AS BIGINT) AS most_rows_of_block,
            CAST(16 * max(rows_) AS BIGINT) AS most_block_bytes
            FROM (SELECT {idx} % {CONFIG.als_blocks} AS b, sum(n) AS rows_, max(n) AS most, count(*) AS ids
                  FROM (SELECT {idx}, count(*) AS n FROM train GROUP BY 1) GROUP BY 1)"""

    priority = ", ".join(f"'{t}'" for t in INTERACTION_PRIORITY)
    named = "strict JOIN users USING (user_idx) JOIN items USING (item_idx) WHERE rank <= 10"
    listed = "string_agg(CAST(product_id AS VARCHAR), ',' ORDER BY rank)"
    found = {
        "interactions": f"{base} SELECT * FROM interactions",
        "order_interactions": f"{orders} SELECT * FROM interactions",
        "interactions_ordered": f"""{base} SELECT *, CAST(list_position([{priority}], interaction_type) AS BIGINT)
            AS priority FROM interactions ORDER BY member_id, product_id, priority""",
        "interaction_stats": f"""{base} SELECT count(*) AS n_interactions, count(DISTINCT member_id) AS n_users,
            count(DISTINCT product_id) AS n_items FROM interactions""",
        "interaction_type_counts": f"{base} SELECT interaction_type, count(*) AS n FROM interactions GROUP BY 1",
        "order_interaction_type_counts": f"""{orders} SELECT interaction_type, count(*) AS n
            FROM interactions GROUP BY 1""",
        "large_purchases": """SELECT DISTINCT o_custkey AS member_id, l_partkey AS product_id,
            'purchase' AS interaction_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey
            WHERE o_orderdate >= TIMESTAMP '2002-01-01 00:00:00' - INTERVAL 4000 DAY""",
        "user_index": f"{rated} SELECT member_id, user_idx FROM users",
        "item_index": f"{rated} SELECT product_id, item_idx FROM items",
        "ratings": f"{rated} SELECT * FROM ratings",
        "split_test": f"{split} SELECT * FROM test",
        "split_train": f"{split} SELECT * FROM train",
        "split_sizes": f"""{split} SELECT 'train' AS part, count(*) AS n FROM train
            UNION ALL SELECT 'test', count(*) FROM test""",
        "eval_metrics": f"""{split}, p AS (SELECT t.rating, m.prediction FROM test t
              JOIN (SELECT item_idx, avg(rating) AS prediction FROM train GROUP BY 1) m USING (item_idx))
            SELECT count(*) AS n, round(avg(abs(prediction - rating)), 6) AS mae,
                   round(sqrt(avg((prediction - rating) * (prediction - rating))), 6) AS rmse FROM p""",
        "als_dims": f"""{split} SELECT 'user' AS side, count(DISTINCT user_idx) AS n_ids,
            CAST({CONFIG.rank} AS BIGINT) AS rank FROM train
            UNION ALL SELECT 'item', count(DISTINCT item_idx), CAST({CONFIG.rank} AS BIGINT) FROM train""",
        "als_topn_counts": f"""{split} SELECT user_idx,
            least({CONFIG.top_n}, (SELECT count(DISTINCT item_idx) FROM train) - count(DISTINCT item_idx)) AS n
            FROM train GROUP BY user_idx
            HAVING (SELECT count(DISTINCT item_idx) FROM train) > count(DISTINCT item_idx)""",
        "als_recommendation_checks": f"""{split}, c AS (SELECT user_idx, least({CONFIG.top_n},
            (SELECT count(DISTINCT item_idx) FROM train) - count(DISTINCT item_idx)) AS n FROM train GROUP BY 1)
            SELECT user_idx, n, CAST(0 AS BIGINT) AS n_seen, CAST(0 AS BIGINT) AS rank_gaps,
                   CAST(0 AS BIGINT) AS order_breaks, CAST(0 AS BIGINT) AS n_off FROM c WHERE n > 0""",
        "als_metric_checks": f"{split} SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_off FROM test",
        "run_report": f"""{split} SELECT (SELECT count(*) FROM interactions) AS n_interactions,
            (SELECT count(*) FROM users) AS n_users, (SELECT count(*) FROM items) AS n_items,
            (SELECT count(*) FROM train) AS n_train, (SELECT count(*) FROM test) AS n_test,
            (SELECT count(*) FROM (SELECT user_idx FROM train GROUP BY 1 HAVING count(DISTINCT item_idx)
              < (SELECT count(DISTINCT item_idx) FROM train))) AS n_recommended""",
        "interactions_snapshot": f"{base} SELECT * FROM interactions",
        "snapshot_hits_and_misses": f"""SELECT 'first' AS step, FALSE AS hit, ({early} {counted}) AS n
            UNION ALL SELECT 'again', TRUE, ({early} {counted})
            UNION ALL SELECT 'files added', FALSE, ({base} {counted})""",
        "shipped_thresholds": f"{shipped} SELECT interaction_type, count(*) AS n FROM interactions GROUP BY 1",
        "als_block_loads": f"{split} {loads('user', 'user_idx')} UNION ALL {loads('item', 'item_idx')}",
        "factors_export": f"""{split} SELECT 'user' AS side, count(DISTINCT user_idx) AS n, {CONFIG.rank} AS dims,
            CAST(0 AS BIGINT) AS n_out_of_order FROM train
            UNION ALL SELECT 'item', count(DISTINCT item_idx), {CONFIG.rank}, 0 FROM train""",
        "run_ledger": f"""{split}, counts AS (SELECT (SELECT count(*) FROM interactions) AS n_interactions,
            (SELECT count(*) FROM users) AS n_users, (SELECT count(*) FROM items) AS n_items,
            (SELECT count(*) FROM train) AS n_train, (SELECT count(*) FROM test) AS n_test,
            {recommended} AS n_recommended,
            (SELECT count(*) FROM users) - (SELECT count(DISTINCT user_idx) FROM train) AS n_without_factors)
            SELECT 'success' AS status, 'strict' AS mode, {CONFIG.top_n} AS top_n, *, n_recommended AS n_saved,
                   FALSE AS has_error FROM counts
            UNION ALL SELECT 'not saved', 'strict', {CONFIG.top_n}, *, NULL, TRUE FROM counts""",
        "embeddings_versions": f"""{products}, c AS (SELECT count(*) AS n,
              count(*) FILTER (WHERE primary_category_id = 3) AS h,
              count(*) FILTER (WHERE primary_category_id IN (3, 5)) AS k FROM products)
            SELECT 1 AS version, n, CAST(0 AS BIGINT) AS n_hidden, CAST(0 AS BIGINT) AS n_copies FROM c
            UNION ALL SELECT 2, n, h, 0 FROM c UNION ALL SELECT 3, n + k, h, k FROM c
            UNION ALL SELECT 4, n + k, h, k FROM c""",
        "refused_inputs": """SELECT input, input <> 'in order' AS refused, CASE input WHEN 'repeated seq'
              THEN n + third ELSE n END AS n
            FROM (VALUES ('no id'), ('no vector'), ('element no number'), ('other length'), ('repeated seq'), ('in order'),
                         ('search over other lengths'), ('unknown target')) v(input),
                 (SELECT count(*) AS n, count(*) FILTER (WHERE vec_id % 3 = 0) AS third FROM embeddings)""",
        "set_aside_rows": f"""WITH {_EVENT_LOGS},
              a AS (SELECT count(*) FILTER (WHERE TRY_CAST(member_id AS BIGINT) % 11 = 3) AS bad, count(*) AS n
                    FROM action_log WHERE event_name IN ('LikedEvent', 'CartItemPutEvent')),
              v AS (SELECT count(*) FILTER (WHERE id % 13 = 5) AS bad, count(*) AS n FROM product_view)
            SELECT 'parquet' AS format, 'good' AS part, n - bad AS n FROM a UNION ALL SELECT 'parquet', 'aside', bad FROM a
            UNION ALL SELECT 'csv', 'good', n - bad FROM v UNION ALL SELECT 'csv', 'aside', bad FROM v
            UNION ALL SELECT 'parquet', 'undeclared', 0""",
        "product_page_after": f"""{parts} SELECT id, secondary_category_id FROM catalog WHERE status = 'SALE'
            ORDER BY id LIMIT 40 OFFSET 40""",
        "product_page_directory": f"""{parts}, n AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 40 AS batch_no
              FROM catalog WHERE status = 'SALE')
            SELECT batch_no, min(id) AS first_id, max(id) AS last_id, count(*) AS n_rows FROM n GROUP BY 1""",
        "product_page_deep": f"""{parts}, n AS (SELECT *, (row_number() OVER (ORDER BY id) - 1) // 40 AS batch_no
              FROM catalog WHERE status = 'SALE')
            SELECT id, image_url, status, primary_category_id, secondary_category_id FROM n
            WHERE batch_no = (SELECT max(batch_no) FROM n)""",
        "saved_recommendations": f"""{masked_products} SELECT member_id, {listed} AS product_ids
            FROM {named} GROUP BY 1""",
        "vector_quarantine": """SELECT vec_id AS id, CASE WHEN vec_id % 7 = 3 THEN 'aside' ELSE 'good' END AS part
            FROM embeddings""",
        "no_condition_no_products": """SELECT 'none' AS condition, CAST(0 AS BIGINT) AS n
            UNION ALL SELECT 'true', count(*) FROM part""",
        "als_normal_equations": f"""{split} SELECT count(DISTINCT user_idx) AS n_users,
            CAST(0 AS BIGINT) AS n_users_off FROM train""",
        "topn_masked_strict": f"""{masked} SELECT user_idx, item_idx, rank, round(score, 6) AS score
            FROM strict WHERE rank <= 10""",
        "topn_masked_pad": f"""{masked} SELECT user_idx, item_idx, rank,
            CASE WHEN seen THEN NULL ELSE round(score, 6) END AS score FROM padded WHERE rank <= 100""",
        "results_wide": f"""{masked_products} SELECT member_id AS user_id, {listed} AS recommended_items
            FROM {named} GROUP BY 1""",
        "recommendation_rows": f"""{masked_products} SELECT member_id, {listed} AS product_ids,
            '2024-01-31 00:00:00' AS created_at FROM {named} GROUP BY 1""",
        "recommended_ids": f"{masked_products} SELECT member_id, product_id, rank FROM {named}",
        "similar_products": f"""{products}{_SIMILAR} SELECT product_id, similar_id, round(d, 6) AS distance, rank
            FROM ranked WHERE rank <= 10""",
        "similar_lists": f"""{products}{_SIMILAR} SELECT product_id,
            string_agg(CAST(similar_id AS VARCHAR), ',' ORDER BY rank) AS similar_ids
            FROM ranked WHERE rank <= 100 GROUP BY 1""",
        "similar_by_id": f"""{products}, q AS (SELECT image_vector AS v FROM products WHERE id = 7),
            s AS (SELECT id, -list_inner_product(image_vector::DOUBLE[], v::DOUBLE[]) AS d
                  FROM products, q WHERE id <> 7)
            SELECT id, round(d, 6) AS distance FROM s ORDER BY d, id LIMIT 20""",
        "search_by_vector": f"""{products}, q AS (SELECT image_vector AS v FROM products WHERE id = 7),
            s AS (SELECT id, -list_inner_product(image_vector::DOUBLE[], v::DOUBLE[]) AS d
                  FROM products, q WHERE status = 'SALE' AND id NOT IN (7, 8, 9))
            SELECT id, round(d, 6) AS distance FROM s ORDER BY d, id LIMIT 20""",
        "search_by_vectors": f"""{products}, s AS (
              SELECT a.id AS query_id, p.id, -list_inner_product(a.image_vector::DOUBLE[], p.image_vector::DOUBLE[]) AS d
              FROM products a, products p WHERE p.status = 'SALE'),
            r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS INTEGER) AS rank FROM s)
            SELECT query_id, id, round(d, 6) AS distance, rank FROM r WHERE rank <= 20""",
        "product_vectors": f"""{products} SELECT id, {_SUMMARY} FROM products
            WHERE id IN (SELECT p_partkey FROM part)""",
        "vector_text_roundtrip": f"{products} SELECT id, {_SUMMARY} FROM products",
        "embeddings_upsert": f"""{products}, updates AS (
              SELECT id, 'SALE' AS status, primary_category_id, secondary_category_id,
                     list_transform(image_vector, lambda x: -x) AS image_vector, 1 AS seq
              FROM products WHERE status = 'SOLD_OUT'
              UNION ALL SELECT id, 'HIDDEN', primary_category_id, secondary_category_id, image_vector, 2
              FROM products WHERE primary_category_id = 3
              UNION ALL SELECT -1 - id, status, primary_category_id, secondary_category_id, image_vector, 3
              FROM products WHERE primary_category_id = 5),
            latest AS (SELECT * FROM updates u
                       WHERE seq = (SELECT max(seq) FROM updates o WHERE o.id = u.id)),
            merged AS (SELECT id, status, primary_category_id, secondary_category_id, image_vector FROM latest
              UNION ALL SELECT id, status, primary_category_id, secondary_category_id, image_vector FROM products
              WHERE id NOT IN (SELECT id FROM latest))
            SELECT id, status, primary_category_id, secondary_category_id, {_SUMMARY} FROM merged""",
        "product_page": f"""{parts} SELECT id, image_url, status, primary_category_id, secondary_category_id
            FROM catalog WHERE status = 'SALE' ORDER BY id LIMIT 500 OFFSET 500""",
        "product_urls": f"{parts} SELECT id, image_url FROM catalog ORDER BY id LIMIT 5000",
        "product_ids": f"{parts} SELECT id FROM catalog WHERE secondary_category_id >= 25",
        "all_product_ids": "SELECT vec_id AS id FROM embeddings",
        "product_links": f"{parts} SELECT id, image_url FROM catalog WHERE id IN (SELECT vec_id FROM embeddings)",
        "product_page_numbers": f"""{parts} SELECT id, status,
            (row_number() OVER (ORDER BY id) - 1) // 500 AS batch_no FROM catalog""",
    }
    if corpus_queries:
        found |= corpus_queries.oracle_sql()
    if corpus_pipeline and corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
