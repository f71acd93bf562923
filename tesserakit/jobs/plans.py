"""Queries of scoring plans: sweeps over candidate settings, one job each; they join the catalogue when it is imported."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from ..plans import sweep
from ..plans.postprocess import Lattice
from ..sources import volumes as v
from ..sources.storage import table
from .catalog import AFF, CLS, EXTENT, VOX, query

#: Two thresholds, two sizes and three fill distances.
THRESHOLDS = sweep.Plan(
    "affinities", "cc_threshold", {"voxel_instance": {"iou_threshold": 0.25}}, {"logits": (10, 7), "min_sizes": (4, 0), "fill_distances": ("all", 0, 2)}
)
FINISHED = sweep.Plan("instances", "identity", {"voxel_instance": {}}, {"min_sizes": (0, 20, 60), "fill_distances": (0, 5)})
CHANCES = sweep.Plan("scores", "class_above", {"semantic": {"ignore": 0}}, {"thresholds": (0.3, 0.2, 0.25)})
CLASS_MAPS = sweep.Plan("classes", "classes", {"semantic": {"ignore": 0}})


def _lattice(spark, sf_dir) -> Lattice:
    """Slabs of the lattice as volumes of their own."""
    return Lattice({"x": F.least((F.col("volume") + 1) * v.SLAB, v.planes(spark, sf_dir)), "y": v.SHAPE_Y, "z": v.SHAPE_Z}, v.STRIDES)


def _met(spark, sf_dir, prediction: DataFrame, columns: list[str]) -> DataFrame:
    truth = v.voxels(spark, sf_dir).drop("pred")
    return sweep.joined(truth, prediction, prediction.select("volume").distinct(), columns)


def _means(plan: sweep.Plan, voxels: DataFrame, lattice: Lattice) -> DataFrame:
    means = sweep.over_volumes(sweep.scored(plan, voxels, lattice))
    return sweep.with_settings(plan, means).select("ordinal", "settings", "metric", "key", F.round("value", 6).alias("value"), "volumes")


def _settings_sql(plan: sweep.Plan) -> str:
    names = ", ".join(f"({i}, '{plan.processor.describe(s)}')" for i, s in enumerate(plan.processor.candidates()))
    return f"st(ordinal, settings) AS (VALUES {names})"


def _scores_sql(iou: float) -> str:
    """Instance scores of cont (ordinal, volume, truth, pred, n) by candidate and volume, and their means."""
    values = {
        "pq": "coalesce(round(sq * rq, 9), 0)", "rq": "round(rq, 9)", "sq": "CASE WHEN tp > 0 THEN round(sq, 9) END", "voi_sum": "round(split + merge, 9)", "voi_split": "round(split, 9)",
        "voi_merge": "round(merge, 9)", "adapted_rand_error": "round(1 - 2 * nn / (tt + pp), 9)", "tp": "tp", "fp": "np - tp", "fn": "nt - tp",
    }
    return f"""tr AS (SELECT ordinal, volume, truth, sum(n)::DOUBLE AS t FROM cont GROUP BY ALL), pr AS (SELECT ordinal, volume, pred, sum(n)::DOUBLE AS p FROM cont GROUP BY ALL),
ob AS (SELECT ordinal, volume, count(DISTINCT truth) FILTER (truth <> 0) AS nt, count(DISTINCT pred) FILTER (pred <> 0) AS np FROM cont GROUP BY ALL),
hi AS (SELECT ordinal, volume, count(*) AS tp, sum(n / (t + p - n)) AS s FROM cont JOIN tr USING (ordinal, volume, truth) JOIN pr USING (ordinal, volume, pred) WHERE truth <> 0 AND pred <> 0 AND n / (t + p - n) > {iou} GROUP BY ALL),
c1 AS (SELECT * FROM cont WHERE truth <> 0), t1 AS (SELECT ordinal, volume, truth, sum(n)::DOUBLE AS t FROM c1 GROUP BY ALL), p1 AS (SELECT ordinal, volume, pred, sum(n)::DOUBLE AS p FROM c1 GROUP BY ALL), a1 AS (SELECT ordinal, volume, sum(n)::DOUBLE AS a, sum(n * n::DOUBLE) AS nn FROM c1 GROUP BY ALL),
vo AS (SELECT ordinal, volume, any_value(nn) AS nn, greatest(-sum(n / a * log2(n / t)), 0.0) AS split, greatest(-sum(n / a * log2(n / p)), 0.0) AS merge FROM c1 JOIN t1 USING (ordinal, volume, truth) JOIN p1 USING (ordinal, volume, pred) JOIN a1 USING (ordinal, volume) GROUP BY ALL),
al AS (SELECT ordinal, volume, coalesce(tp, 0) AS tp, nt, np, s / tp AS sq, coalesce(tp, 0) / (coalesce(tp, 0) + 0.5 * (np - coalesce(tp, 0)) + 0.5 * (nt - coalesce(tp, 0))) AS rq, split, merge, nn, tt, pp
  FROM ob LEFT JOIN hi USING (ordinal, volume) JOIN vo USING (ordinal, volume) JOIN (SELECT ordinal, volume, sum(t * t) AS tt FROM t1 GROUP BY ALL) USING (ordinal, volume) JOIN (SELECT ordinal, volume, sum(p * p) AS pp FROM p1 GROUP BY ALL) USING (ordinal, volume)),
me AS (SELECT ordinal, key, avg(value) AS value, count(*) AS volumes FROM ({' UNION ALL '.join(f"SELECT ordinal, '{k}' AS key, {e}::DOUBLE AS value FROM al" for k, e in values.items())}) WHERE value IS NOT NULL GROUP BY ALL)"""


RESULT_SQL = "SELECT ordinal, settings, '{}' AS metric, key, round(value, 6) AS value, volumes FROM me JOIN st USING (ordinal)"
COMPONENTS_SQL = f"""{VOX}, {AFF}, {EXTENT}, lg(j, thr) AS (VALUES {', '.join(f'({i}, {graph.threshold_of(x)!r}::DOUBLE)' for i, x in enumerate((7, 10)))}),
th AS (SELECT j, aff.*, a0 > thr AS p0, a1 > thr AS p1, a2 > thr AS p2 FROM aff, lg),
ln AS (SELECT j, lin AS a, lin + 500 AS b FROM th, ext WHERE p0 AND x + 1 < least((volume + 1) * 5, sx) UNION ALL SELECT j, lin, lin + 20 FROM th WHERE p1 AND y + 1 < 25 UNION ALL SELECT j, lin, lin + 1 FROM th WHERE p2 AND z + 1 < 20),
sy AS (SELECT j, a, b FROM ln UNION ALL SELECT j, b, a FROM ln), nd AS (SELECT j, lin FROM th WHERE p0 OR p1 OR p2 UNION SELECT j, b FROM ln),
re AS (SELECT j, lin AS node, lin AS root FROM nd UNION SELECT re.j, b, root FROM re JOIN sy ON sy.j = re.j AND node = a WHERE root < b),
lb AS (SELECT lg.j, vox.volume, vox.lin, x, y, z, truth, coalesce(label, 0) AS label FROM vox CROSS JOIN lg LEFT JOIN (SELECT j, node, min(root) + 1 AS label FROM re GROUP BY j, node) r ON r.j = lg.j AND node = vox.lin)"""


def _filled_sql(sizes: tuple[int, ...], fills: tuple[tuple[float, str], ...]) -> str:
    """lb (j, volume, lin, x, y, z, truth, label) under sizes and fills, as cont."""
    d2 = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
    return f"""sz AS (SELECT j, volume, label, count(*) AS size FROM lb GROUP BY ALL), g(m, min_size) AS (VALUES {', '.join(map(str, enumerate(sizes)))}),
fl AS (SELECT j, m, volume, lin, x, y, z, truth, CASE WHEN size >= min_size THEN label ELSE 0 END AS pred FROM lb JOIN sz USING (j, volume, label), g),
nr AS (SELECT a.j, a.m, a.lin, min({d2}) AS d2, arg_min(b.pred, {d2} * 1000000000 + b.lin) AS near FROM fl a JOIN fl b ON a.j = b.j AND a.m = b.m AND a.volume = b.volume WHERE a.pred = 0 AND b.pred <> 0 GROUP BY ALL),
ff(f, reach) AS (VALUES {', '.join(f'({i}, {r})' for i, (r, _) in enumerate(fills))}),
cont AS (SELECT CAST((fl.j * {len(sizes)} + fl.m) * {len(fills)} + f AS INTEGER) AS ordinal, volume, truth, CASE WHEN pred = 0 AND reach > 0 AND d2 <= reach THEN near ELSE pred END AS pred, count(*) AS n FROM fl LEFT JOIN nr ON nr.j = fl.j AND nr.m = fl.m AND nr.lin = fl.lin, ff GROUP BY ALL)"""


SWEEP_SQL = f"WITH RECURSIVE {COMPONENTS_SQL}, {_filled_sql((0, 4), ((0, '0'), (4, '2'), (1e18, 'all')))}, {_scores_sql(0.25)}, {_settings_sql(THRESHOLDS)}"


@query(f"{SWEEP_SQL} {RESULT_SQL.format('voxel_instance')}")
def sweep_thresholds(spark, sf_dir):
    """Thresholds, components, minimum sizes, fills and scores of all candidates over all volumes, in one plan."""
    voxels = _met(spark, sf_dir, v.affinities(spark, sf_dir), ["a0", "a1", "a2"])
    return _means(THRESHOLDS, voxels, _lattice(spark, sf_dir))


@query(f"{SWEEP_SQL} SELECT ordinal, round(value, 6) AS value FROM me WHERE key = 'pq' QUALIFY row_number() OVER (ORDER BY me.value DESC, ordinal) = 1")
def sweep_best(spark, sf_dir):
    """The candidate of ``sweep_thresholds`` that ranks first."""
    voxels = _met(spark, sf_dir, v.affinities(spark, sf_dir), ["a0", "a1", "a2"])
    means = sweep.over_volumes(sweep.scored(THRESHOLDS, voxels, _lattice(spark, sf_dir)))
    return sweep.best(THRESHOLDS, means).select("ordinal", F.round("value", 6).alias("value"))


@query(f"WITH {VOX}, lb AS (SELECT 0 AS j, volume, lin, x, y, z, truth, pred AS label FROM vox), {_filled_sql((0, 20, 60), ((0, '0'), (25, '5')))}, {_scores_sql(0.5)}, {_settings_sql(FINISHED)} {RESULT_SQL.format('voxel_instance')}")
def sweep_finished(spark, sf_dir):
    """Minimum sizes and a fill of a finished labelling."""
    prediction = v.voxels(spark, sf_dir).drop("truth")
    return _means(FINISHED, _met(spark, sf_dir, prediction, ["pred"]), _lattice(spark, sf_dir))


def _semantic_sql(plan: sweep.Plan) -> str:
    """Pooled class scores of cont (ordinal, truth, pred, n)."""
    return f"""ac AS (SELECT ordinal, truth AS class, sum(n) AS actual, sum(CASE WHEN truth = pred THEN n ELSE 0 END) AS hit FROM cont WHERE truth <> 0 GROUP BY ALL), pd AS (SELECT ordinal, pred AS class, sum(n) AS predicted FROM cont WHERE truth <> 0 GROUP BY ALL),
wi AS (SELECT ordinal, avg(hit / (actual + coalesce(predicted, 0) - hit)) AS mean_iou, avg(2 * hit / (actual + coalesce(predicted, 0))) AS mean_dice, sum(hit) / sum(actual) AS accuracy, count(*)::DOUBLE AS n_classes FROM ac LEFT JOIN pd USING (ordinal, class) GROUP BY ordinal),
me AS (SELECT ordinal, key, value, 1::BIGINT AS volumes FROM (UNPIVOT wi ON mean_iou, mean_dice, accuracy, n_classes INTO NAME key VALUE value)), {_settings_sql(plan)} {RESULT_SQL.format('semantic')}"""


@query(f"""WITH sc AS (SELECT vec_id % 4 AS volume, 1 + vec_id % 7 AS truth, list_position(embedding, list_max(embedding)) - 1 AS class, list_max(embedding) AS top FROM embeddings),
cont AS (SELECT ordinal, truth, CASE WHEN top >= thr THEN class ELSE 0 END AS pred, count(*) AS n FROM sc, (VALUES (0, 0.2::DOUBLE), (1, 0.25::DOUBLE), (2, 0.3::DOUBLE)) g(ordinal, thr) GROUP BY ALL), {_semantic_sql(CHANCES)}""")
def sweep_classes(spark, sf_dir):
    """Class thresholds over score vectors, scored on one table of all volumes."""
    voxels = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 4).alias("volume"), F.col("vec_id").alias("lin"), (1 + F.col("vec_id") % 7).alias("truth"), F.col("embedding").alias("scores"))
    return _means(CHANCES, voxels, Lattice({}, {}))


@query(f"WITH {CLS}, cont AS (SELECT 0 AS ordinal, truth, pred, count(*) AS n FROM cls GROUP BY ALL), {_semantic_sql(CLASS_MAPS)}")
def score_class_map(spark, sf_dir):
    """A finished class map, scored on one table of all volumes."""
    voxels = v.class_map(spark, sf_dir).withColumn("lin", F.lit(0).cast("long"))
    return _means(CLASS_MAPS, voxels, Lattice({}, {}))
