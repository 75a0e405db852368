"""Queries of the density search, hierarchies, early stopping with a margin, hub datasets, caches and services."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tessera.operators import cleaning, clusters, density, graders, history
from tessera.operators.agents import FatalError
from tessera.operators.embedding import Client, Store
from tessera.operators.graders import Tier
from tessera.plans.q_agents import _folder
from tessera.plans.q_eval import r6
from tessera.plans.registry import query
from tessera.sources import hub, images, readers, writers
from tessera.sources.cache import FeatureCache
from tessera.streaming import streams

# Embeddings moved apart by label, so that there are clusters to find.
APART = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x, i: x::DOUBLE + ((label + 1) * i) % 11) AS v FROM embeddings)"


def _apart(i):
    shift = lambda x, n: x.cast("double") + ((F.col("label") + 1) * (n + 1)) % 11
    return i.table("embeddings").select("vec_id", "label", F.transform("embedding", shift).alias("embedding"))


GRID = f"""WITH RECURSIVE {APART}, p AS (SELECT a.vec_id AS k, b.vec_id AS j, list_distance(a.v, b.v) AS d FROM e a CROSS JOIN e b),
 r AS (SELECT k, d, row_number() OVER (PARTITION BY k ORDER BY d, j) AS rank FROM p), kd AS (SELECT k, avg(d) AS x FROM r WHERE rank BETWEEN 4 AND 11 GROUP BY k),
 w AS (SELECT greatest(0.1, quantile_cont(x, 0.25) / 2) AS low, least(2.0, quantile_cont(x, 0.9) * 2) AS high FROM kd),
 g AS (SELECT s.step AS step, w.low + (w.high - w.low) * s.step / 9 AS eps FROM w CROSS JOIN (SELECT unnest(range(10)) AS step) s),
 core AS (SELECT g.step AS step, r.rank AS m, r.k AS k FROM r JOIN g ON r.d <= g.eps WHERE r.rank BETWEEN 3 AND 10),
 links AS MATERIALIZED (SELECT g.step AS step, p.k AS k, p.j AS j FROM p JOIN g ON p.d <= g.eps),
 label(step, m, k, c) USING KEY (step, m, k) AS (
   SELECT step, m, k, k FROM core
   UNION
   SELECT u.step, u.m, u.k, u.c FROM (
     SELECT n.step AS step, n.m AS m, n.k AS k, min(l.c) AS c FROM label l JOIN links x ON x.step = l.step AND x.j = l.k
     JOIN recurring.label n ON n.step = l.step AND n.m = l.m AND n.k = x.k GROUP BY n.step, n.m, n.k) u
   JOIN recurring.label o ON o.step = u.step AND o.m = u.m AND o.k = u.k WHERE u.c < o.c),
 reached AS (SELECT DISTINCT c.step, c.m, x.k FROM core c JOIN links x ON x.step = c.step AND x.j = c.k)
SELECT g.step AS step, s.m AS min_samples, round(g.eps, 6) AS eps, (SELECT count(DISTINCT c) FROM label l WHERE l.step = g.step AND l.m = s.m) AS clusters,
 round(1 - (SELECT count(*) FROM reached x WHERE x.step = g.step AND x.m = s.m) / (SELECT count(*) FROM e), 6) AS noise
FROM g CROSS JOIN (SELECT unnest(range(3, 11)) AS m) s"""


@query(GRID)
def dbscan_grid(i):
    found = density.search(_apart(i), "vec_id")
    rows = [(n // 8, int(s.min_samples), float(s.eps), int(s.clusters), float(s.noise)) for n, s in enumerate(found.itertuples())]
    return r6(i.spark.createDataFrame(rows, "step long, min_samples long, eps double, clusters long, noise double"), "eps", "noise")


@query(
    f"""WITH RECURSIVE {APART}, links AS MATERIALIZED (SELECT a.vec_id AS k, b.vec_id AS j FROM e a JOIN e b ON a.label = b.label WHERE list_distance(a.v, b.v) <= 1.15),
    part(k, c) USING KEY (k) AS (
      SELECT vec_id, vec_id FROM e
      UNION
      SELECT u.k, u.c FROM (SELECT x.k AS k, min(l.c) AS c FROM part l JOIN links x ON x.j = l.k GROUP BY x.k) u JOIN recurring.part o ON o.k = u.k WHERE u.c < o.c)
    SELECT CAST(e.label AS VARCHAR) AS grp, e.vec_id AS key, CAST(dense_rank() OVER (PARTITION BY e.label ORDER BY p.c) - 1 AS INTEGER) AS label FROM e JOIN part p ON e.vec_id = p.k"""
)
def single_linkage(i):
    return clusters.agglomerative(_apart(i), "label", "vec_id", height=1.15, linkage="single", small=16)


@query()
def ward_rounds(i):
    """Every label's hierarchy, in rounds until 32 clusters are left for one task."""
    return clusters.agglomerative(i.table("embeddings"), "label", "vec_id", k=3, small=32)


@query()
def bisecting_kmeans(i):
    return clusters.bisecting(_apart(i), 10, "vec_id")


MARGIN = """WITH RECURSIVE h AS (SELECT run, epoch, val_loss, row_number() OVER (PARTITION BY run ORDER BY epoch, val_loss) AS n FROM ({v_history}) t),
 f(run, n, epoch, best, waited, stopped) AS (
   SELECT run, n, epoch, val_loss, 0, false FROM h WHERE n = 1
   UNION ALL
   SELECT h.run, h.n, h.epoch, CASE WHEN h.val_loss < f.best - 150 THEN h.val_loss ELSE f.best END, CASE WHEN h.val_loss < f.best - 150 THEN 0 ELSE f.waited + 1 END,
          f.stopped OR (h.val_loss >= f.best - 150 AND f.waited + 1 >= 3)
   FROM f JOIN h ON h.run = f.run AND h.n = f.n + 1)
 SELECT run, epoch, best, CAST(waited AS BIGINT) AS waited, stopped FROM f"""


@query(MARGIN)
def early_stop_margin(i):
    found = history.early_stopping(i.view("v_history"), min_delta=150.0)
    return found.select("run", "epoch", "best", F.col("waited").cast("long").alias("waited"), "stopped")


def _hub_set(i) -> str:
    """Benchmark items as a dataset of two splits, some shards each."""
    base = _folder(i)
    for split, rows in (("test", "item_id % 4 = 0"), ("train", "item_id % 4 <> 0")):
        i.table("benchmark").where(rows).repartition(3, "item_id").write.parquet(f"{base}/default/{split}")
    return base


@query("SELECT item_id, text, 'test' AS split FROM benchmark WHERE item_id % 4 = 0")
def hub_dataset(i):
    return hub.load(i.spark, _hub_set(i)).where("split = 'test'")


@query("SELECT split, count(*) AS n, sum(length(text)) AS chars FROM (SELECT text, CASE WHEN item_id % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM benchmark) t GROUP BY split")
def hub_splits(i):
    return hub.load(i.spark, _hub_set(i)).groupBy("split").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT item_id, text FROM benchmark WHERE item_id % 4 <> 0")
def hub_stream(i):
    out = _folder(i)
    streams.run_to_parquet(hub.load(i.spark, _hub_set(i), "train", stream=True).drop("split"), out, _folder(i))
    return i.spark.read.schema("item_id long, text string").parquet(out)


@query("SELECT vec_id, vec_id // 50 AS batch, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 5) AS square FROM embeddings")
def feature_cache_resume(i):
    """A run that breaks off half-way, and one that goes on: the second makes what is missing only."""
    cache = FeatureCache(i.spark, _folder(i))
    rows = i.table("embeddings").select("vec_id", F.expr("vec_id div 50").alias("batch"), "embedding")
    half = rows.agg(F.floor(F.max("batch") / 2)).first()[0]
    square = lambda df: df.select("vec_id", "batch", F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")).alias("square"))

    def breaks(df):
        return square(df).withColumn("square", F.when(F.col("batch") > half, F.raise_error(F.lit("the run breaks off")).cast("double")).otherwise(F.col("square")))

    try:
        cache.fill("squares", rows, breaks, jobs=4)
        raise AssertionError("the first run ends whole")
    except Exception as e:
        if "breaks off" not in str(e):
            raise
    written_once = cache.manifest("squares").select("batch")
    cache.fill("squares", rows, lambda df: square(df.join(written_once, "batch", "left_anti")), jobs=4)
    return cache.read("squares").select("vec_id", "batch", F.round("square", 5).alias("square"))


def _letters(texts: list[str]) -> list[list[float]]:
    """Counts of characters and blanks; fails for a batch with a text on wheat."""
    if any("wheat" in x for x in texts):
        raise FatalError("no vector for wheat")
    return [[float(len(x)), float(x.count(" "))] for x in texts]


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'wheat') THEN NULL ELSE length(p_name)::DOUBLE END AS characters, CASE WHEN contains(p_name, 'wheat') THEN NULL ELSE (length(p_name) - length(replace(p_name, ' ', '')))::DOUBLE END AS blanks, CASE WHEN contains(p_name, 'wheat') THEN 'FatalError: no vector for wheat' END AS error FROM part")
def embedding_store(i):
    """Part names by a service that refuses some; the second call finds the others in the store."""
    store, client = Store(i.spark, _folder(i)), Client(_letters, "letters", batch=1)
    store.fill(i.table("part").where("p_partkey % 2 = 0"), "p_name", client)
    found = store.embed(i.table("part").select("p_partkey", "p_name"), "p_name", client)
    return found.select("p_partkey", F.get("embedding", F.lit(0)).alias("characters"), F.get("embedding", F.lit(1)).alias("blanks"), "error")


class _Grader:
    """Scores by the item number in a prompt; one tier fails and one babbles at some of them."""

    def __init__(self, cap: str):
        self.cap = cap

    def load(self) -> None:
        if self.cap == "broken":
            raise OSError("no weights")

    def generate(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            n = int(p.split(":")[0])
            if self.cap == "normal" and n % 3 == 0:
                raise TimeoutError("busy")
            out.append("well, " * (self.cap == "sota" and n % 5 == 0) or f'Here: {{"correctness_score": {n % 11}, "training_quality_score": {n % 7}, "correctness_confidence": 0.75, "recommended_metrics": ["a", "b"]}}')
        return out


@query(
    """WITH g AS (SELECT d.doc_id AS id, c.cap AS cap, (c.cap = 'normal' AND d.doc_id % 3 = 0) OR (c.cap = 'sota' AND d.doc_id % 5 = 0) OR c.cap IN ('broken', 'odd') AS lost
    FROM documents d CROSS JOIN (VALUES ('weak'), ('normal'), ('sota'), ('broken'), ('odd')) c(cap))
    SELECT id, cap, lost AS is_fallback, CASE WHEN lost THEN 5.0 ELSE id % 11 END::DOUBLE AS corr, CASE WHEN lost THEN 5.0 ELSE id % 7 END::DOUBLE AS train, CASE WHEN lost THEN 0.5 ELSE 0.75 END::DOUBLE AS corr_conf, CASE WHEN lost THEN 0 ELSE 2 END AS n_metrics,
    CASE WHEN cap = 'normal' AND lost THEN 'TimeoutError: busy' WHEN cap = 'broken' THEN 'OSError: no weights' WHEN cap = 'odd' THEN 'ValueError: unknown kind of model ''radio''' END AS error FROM g"""
)
def three_tiers(i):
    """Every document by five tiers: a service that fails at times, one that babbles, one that can't load, and one of unknown kind."""
    tiers = [Tier("weak", "local", partial(_Grader, "weak")), Tier("normal", "api", partial(_Grader, "normal")), Tier("sota", "hub", partial(_Grader, "sota")), Tier("broken", "local", partial(_Grader, "broken")), Tier("odd", "radio", partial(_Grader, "odd"))]
    prompts = i.table("documents").select(F.col("doc_id").alias("id"), F.concat(F.col("doc_id").cast("string"), F.lit(": "), F.coalesce("text", F.lit(""))).alias("prompt"))
    return graders.evaluate(prompts, tiers, "id").select(F.col("sample_id").alias("id"), "cap", "is_fallback", "corr", "train", "corr_conf", "n_metrics", "error")


PICTURES = """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'path' WHEN 1 THEN 'path' WHEN 2 THEN 'base64' WHEN 3 THEN 'url' ELSE 'path' END AS kind,
 CASE WHEN p_partkey % 5 IN (0, 2) THEN 'png' WHEN p_partkey % 5 = 1 THEN 'gif' END AS format,
 CASE WHEN p_partkey % 5 < 3 THEN p_size + 300 END AS width, CASE WHEN p_partkey % 5 < 3 THEN p_partkey % 1000 + 1 END AS height,
 CASE WHEN p_partkey % 5 = 3 THEN 'no fetch function' WHEN p_partkey % 5 = 4 THEN 'no such file' END AS error FROM part"""


@query(PICTURES)
def image_headers(i):
    """Pictures of each part's size: files, data URIs, URLs that nothing fetches, and files that aren't there."""
    number = lambda x, digits: F.lpad(F.hex(x), digits, "0")
    swapped = lambda x: F.concat(F.substring(number(x, 4), 3, 2), F.substring(number(x, 4), 1, 2))
    wide, high = F.col("p_size").cast("long") + 300, F.col("p_partkey") % 1000 + 1
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number(wide, 8), number(high, 8), F.lit("0802000000"))
    gif = F.concat(F.lit("474946383961"), swapped(wide), swapped(high), F.lit("800000"))
    kind = F.col("p_partkey") % 5
    rows = i.table("part").select(F.col("p_partkey").alias("id"), kind.alias("k"), F.unhex(F.when(kind == 1, gif).otherwise(png)).alias("bytes"))
    rows = rows.withColumn("name", F.concat(F.lit("pictures/"), (F.col("id") % 7).cast("string"), F.lit("/"), F.col("id").cast("string"), F.lit(".img")))
    base = _folder(i)
    images.write_files(rows.where("k < 2"), "name", "bytes", base)
    uri = F.concat(F.lit("data:image/png;base64,"), F.base64("bytes"))
    named = rows.select("id", F.when(F.col("k") == 2, uri).when(F.col("k") == 3, F.concat(F.lit("https://pictures.example/"), "name")).otherwise(F.col("name")).alias("image"))
    return images.load(named, "image", base).select("id", "kind", "format", "width", "height", "error")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT r_regionkey + 100, r_name FROM region")
def task_file(i):
    """Task files as a list and as a list under data; a single record and a missing file are errors."""
    base, schema = _folder(i), "id long, name string"
    entry = lambda table, key, name, plus: i.table(table).select(F.collect_list(F.struct((F.col(key) + plus).cast("long").alias("id"), F.col(name).alias("name"))).alias("data"))
    entry("nation", "n_nationkey", "n_name", 0).select(F.to_json("data").alias("value")).coalesce(1).write.text(f"{base}/list")
    entry("region", "r_regionkey", "r_name", 100).select(F.to_json(F.struct("data")).alias("value")).coalesce(1).write.text(f"{base}/data")
    i.table("region").limit(1).select(F.to_json(F.struct(F.lit(1).alias("id"), F.col("r_name").alias("name"))).alias("value")).coalesce(1).write.text(f"{base}/one")
    for path, kind in ((f"{base}/one", ValueError), (f"{base}/none", FileNotFoundError)):
        try:
            readers.json_data(i.spark, path, schema, strict=True)
        except kind:
            continue
        raise AssertionError(f"{path} was read")
    return readers.json_data(i.spark, f"{base}/list", schema, strict=True).unionByName(readers.json_data(i.spark, f"{base}/data", schema, strict=True))


@query("SELECT CAST(embedding[1] > 0 AS BIGINT) AS cluster_id, vec_id AS sample_id, count(*) OVER (PARTITION BY embedding[1] > 0) AS size FROM embeddings")
def cluster_job(i):
    """Features by batches, clusters by the sign of the first component, a cluster file, and the cache dropped."""
    cache, out = FeatureCache(i.spark, _folder(i)), _folder(i)
    extract = lambda df: df.select("vec_id", "batch", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    fit = lambda df: df.select("vec_id", (F.col("embedding")[0] > 0).cast("long").alias("label"))
    save = lambda df: writers.cluster_file(df.withColumn("kind", F.lit("vector")), out, ["kind"], "vec_id", "label")
    clusters.cluster_job(i.table("embeddings").select("vec_id", "embedding"), "vec_id", extract, fit, cache, "features", save, batch=100)
    try:
        cache.read("features")
        raise AssertionError("the cache is left")
    except FileNotFoundError:
        pass
    back = i.spark.read.schema("cluster_id long, part int, size long, samples array<struct<sample_id:bigint>>").json(out)
    return back.select("cluster_id", F.explode("samples.sample_id").alias("sample_id"), "size")


PROFILE = """SELECT count(*) AS total, 'doc_id,text,question,image_path' AS fields, min_by(doc_id, doc_id) AS first_id, 'image_path' AS image_field,
 min(length(text))::DOUBLE AS text_min, max(length(text))::DOUBLE AS text_max, round(avg(length(text)), 6) AS text_avg, round(avg(length(lang)), 6) AS question_avg, true AS no_caption FROM documents"""


@query(PROFILE)
def dataset_profile(i):
    rows = i.table("documents").select("doc_id", "text", F.col("lang").alias("question"), F.col("source").alias("image_path"))
    p = cleaning.dataset_profile(rows, "doc_id")
    first = F.get_json_object("sample", "$.doc_id").cast("long")
    return p.select("total", F.array_join("fields", ",").alias("fields"), first.alias("first_id"), "image_field", F.col("text_length.min").alias("text_min"), F.col("text_length.max").alias("text_max"), F.round("text_length.avg", 6).alias("text_avg"), F.round("question_length.avg", 6).alias("question_avg"), F.col("caption_length").isNull().alias("no_caption"))
