"""All registered queries by name, with the SQL that gives the same rows on another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..functions.text import describe_filter, run_identifier
from ..operators import board, graph, grids, labels, metrics, mws, skeletons, tiling
from ..sources import volumes as v
from ..sources.storage import cut, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


VOX, AFF, CLS, SKEL, SUB, BOX = v.VOXELS_SQL, v.AFFINITIES_SQL, v.CLASS_SQL, v.SKELETON_SQL, v.SUBMISSIONS_SQL, v.BOXES_SQL
CONT = f"{VOX}, cont AS (SELECT truth, pred, count(*) AS n FROM vox GROUP BY truth, pred)"
CONT_V = f"{VOX}, cont AS (SELECT volume, truth, pred, count(*) AS n FROM vox GROUP BY volume, truth, pred)"


def _contingency(voxels: DataFrame, by: list[str] = ()) -> DataFrame:
    """The contingency table, made once: metrics read it several times, and voxels no more."""
    return cut(metrics.contingency(voxels, by), "contingency")


# -- contingency and instance metrics -------------------------------------------------------------------------
@query(f"WITH {VOX} SELECT volume, truth, pred, count(*) AS n FROM vox GROUP BY volume, truth, pred")
def contingency(spark, sf_dir):
    return metrics.contingency(v.voxels(spark, sf_dir), ["volume"])


@query(f"WITH {VOX} SELECT truth, pred, count(*) AS n FROM vox WHERE truth <> 0 GROUP BY truth, pred")
def contingency_ignore(spark, sf_dir):
    return metrics.contingency(v.voxels(spark, sf_dir), ignore=0)


@query(
    f"WITH {VOX} SELECT truth, pred, CAST(grouping(truth, pred) AS BIGINT) AS level, count(*) AS n FROM vox GROUP BY GROUPING SETS ((truth, pred), (truth), (pred), ())"
)
def marginals(spark, sf_dir):
    return metrics.marginals(v.voxels(spark, sf_dir))


def _voi_sql(where: str) -> str:
    return f"""WITH {CONT}, c AS (SELECT * FROM cont {where}), t AS (SELECT truth, sum(n) AS t FROM c GROUP BY truth), p AS (SELECT pred, sum(n) AS p FROM c GROUP BY pred), a AS (SELECT sum(n) AS a FROM c),
s AS (SELECT greatest(-sum(n / a * log2(n / t)), 0.0) AS split, greatest(-sum(n / a * log2(n / p)), 0.0) AS merge FROM c JOIN t USING (truth) JOIN p USING (pred), a)
SELECT round(split, 9) AS voi_split, round(merge, 9) AS voi_merge, round(split + merge, 9) AS voi_sum FROM s"""


@query(_voi_sql("WHERE truth <> 0"))
def voi(spark, sf_dir):
    return metrics.variation_of_information(_contingency(v.voxels(spark, sf_dir)))


@query(_voi_sql(""))
def voi_with_background(spark, sf_dir):
    return metrics.variation_of_information(_contingency(v.voxels(spark, sf_dir)), background=None)


@query(f"""WITH {CONT}, c AS (SELECT * FROM cont WHERE truth <> 0), t AS (SELECT sum(s * s::DOUBLE) AS tt FROM (SELECT sum(n)::BIGINT AS s FROM c GROUP BY truth)),
p AS (SELECT sum(s * s::DOUBLE) AS pp FROM (SELECT sum(n)::BIGINT AS s FROM c GROUP BY pred)), q AS (SELECT sum(n * n::DOUBLE) AS nn FROM c)
SELECT round(1 - 2 * nn / (tt + pp), 9) AS adapted_rand_error FROM t, p, q""")
def adapted_rand(spark, sf_dir):
    return metrics.adapted_rand(_contingency(v.voxels(spark, sf_dir)))


def _pq_sql(by: str, thresholds: str, last: str) -> str:
    b = f"{by}, " if by else ""
    using_t, using_p = f"USING ({b}truth)", f"USING ({b}pred)"
    return f"""WITH {CONT_V if by else CONT}, t AS (SELECT {b}truth, sum(n) AS t FROM cont GROUP BY {b}truth), p AS (SELECT {b}pred, sum(n) AS p FROM cont GROUP BY {b}pred),
m AS (SELECT {b}truth, pred, n / (t + p - n) AS iou FROM cont JOIN t {using_t} JOIN p {using_p} WHERE truth <> 0 AND pred <> 0),
o AS (SELECT {b}count(DISTINCT truth) FILTER (truth <> 0) AS nt, count(DISTINCT pred) FILTER (pred <> 0) AS np FROM cont {'GROUP BY ' + by if by else ''}),
l(threshold) AS (VALUES {thresholds}),
h AS (SELECT {b}threshold, count(*) AS tp, sum(iou) AS s FROM m, l WHERE iou > threshold GROUP BY {b}threshold),
f AS (SELECT o.*, l.threshold, coalesce(tp, 0) AS tp, coalesce(s, 0) AS s FROM o CROSS JOIN l LEFT JOIN h ON h.threshold = l.threshold {f'AND h.{by} = o.{by}' if by else ''}),
g AS (SELECT *, CASE WHEN tp > 0 THEN s / tp ELSE 0 END AS sq, tp / (tp + 0.5 * (np - tp) + 0.5 * (nt - tp)) AS rq FROM f),
r AS (SELECT {b}threshold, CAST(tp AS BIGINT) AS tp, CAST(np - tp AS BIGINT) AS fp, CAST(nt - tp AS BIGINT) AS fn, round(sq, 9) AS sq, round(rq, 9) AS rq, round(sq * rq, 9) AS pq FROM g)
{last}"""


@query(_pq_sql("", "(0.5::DOUBLE)", "SELECT * FROM r"))
def panoptic_quality(spark, sf_dir):
    return metrics.panoptic_quality(_contingency(v.voxels(spark, sf_dir)))


@query(_pq_sql("volume", "(0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)", "SELECT * FROM r"))
def pq_threshold_sweep(spark, sf_dir):
    return metrics.panoptic_quality(_contingency(v.voxels(spark, sf_dir), ["volume"]), [0.25, 0.5, 0.75], ["volume"])


@query(f"""WITH {CONT}, t AS (SELECT truth, sum(n) AS t FROM cont GROUP BY truth), p AS (SELECT pred, sum(n) AS p FROM cont GROUP BY pred),
m AS (SELECT truth, pred FROM cont JOIN t USING (truth) JOIN p USING (pred) WHERE truth <> 0 AND pred <> 0 AND n / (t + p - n) > 0.5)
SELECT 'fn' AS side, truth AS id FROM t WHERE truth <> 0 AND truth NOT IN (SELECT truth FROM m) UNION ALL SELECT 'fp', pred FROM p WHERE pred <> 0 AND pred NOT IN (SELECT pred FROM m)""")
def unmatched_instances(spark, sf_dir):
    return metrics.unmatched(_contingency(v.voxels(spark, sf_dir)))


@query(
    _pq_sql(
        "volume", "(0.5::DOUBLE)",
        "SELECT u.metric, round(avg(u.value), 6) AS mean, count(*) AS volumes_scored FROM (SELECT 'pq' AS metric, pq AS value FROM r UNION ALL SELECT 'rq', rq FROM r UNION ALL SELECT 'sq', sq FROM r WHERE tp > 0) u GROUP BY u.metric",
    )
)
def metrics_by_volume_mean(spark, sf_dir):
    scored = metrics.panoptic_quality(_contingency(v.voxels(spark, sf_dir), ["volume"]), by=["volume"])
    long = scored.select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), (F.col(k) if k != "sq" else F.when(F.col("tp") > 0, F.col("sq"))).alias("value")) for k in ("pq", "rq", "sq")))).alias("m")).select("m.*")
    return long.filter("value IS NOT NULL").groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("volumes_scored"))


@query(f"""WITH {CONT}, b AS (SELECT truth, pred, row_number() OVER (PARTITION BY truth ORDER BY n DESC, pred) AS k FROM cont WHERE truth <> 0), m AS (SELECT truth, pred FROM b WHERE k = 1)
SELECT truth, pred AS majority, CASE WHEN pred = 0 THEN 'missed' WHEN count(*) OVER (PARTITION BY pred) > 1 THEN 'merged' ELSE 'ok' END AS status FROM m""")
def majority_agreement(spark, sf_dir):
    return metrics.majority(metrics.contingency(v.voxels(spark, sf_dir)))


@query(f"""WITH {VOX}, s AS (SELECT volume, pred, count(*) AS n FROM vox WHERE pred <> 0 GROUP BY volume, pred)
SELECT volume, pred AS largest, n AS size, round(n / sum(n) OVER w, 9) AS share FROM (SELECT *, row_number() OVER (PARTITION BY volume ORDER BY n DESC, pred) AS k FROM s) WINDOW w AS (PARTITION BY volume) QUALIFY k = 1""")
def largest_component(spark, sf_dir):
    sizes = v.voxels(spark, sf_dir).filter("pred <> 0").groupBy("volume", "pred").agg(F.count("*").alias("n"))
    best = sizes.groupBy("volume").agg(F.min_by(F.struct("pred", "n"), F.struct(-F.col("n"), "pred")).alias("b"), F.sum("n").alias("all"))
    return best.select("volume", F.col("b.pred").alias("largest"), F.col("b.n").alias("size"), F.round(F.col("b.n") / F.col("all"), 9).alias("share"))


# -- filters on labels ----------------------------------------------------------------------------------------
@query(f"WITH {VOX} SELECT lin, CASE WHEN count(*) OVER (PARTITION BY volume, pred) >= 40 THEN pred ELSE 0 END AS pred FROM vox")
def size_filter(spark, sf_dir):
    return labels.size_filter(v.voxels(spark, sf_dir), "pred", 40, ["volume"]).select("lin", "pred")


@query(f"""WITH {CONT_V}, s AS (SELECT volume, pred, sum(n) AS size FROM cont GROUP BY volume, pred), g(min_size) AS (VALUES (0), (20), (40), (60))
SELECT min_size, CAST(sum(n) FILTER (pred <> 0 AND size >= min_size) AS BIGINT) AS voxels, count(DISTINCT (volume, pred)) FILTER (pred <> 0 AND size >= min_size) AS objects FROM cont JOIN s USING (volume, pred), g GROUP BY min_size""")
def size_filter_sweep(spark, sf_dir):
    swept = board.sweep_sizes(_contingency(v.voxels(spark, sf_dir), ["volume"]), [0, 20, 40, 60], ["volume"]).filter("pred <> 0")
    return swept.groupBy("min_size").agg(F.sum("n").alias("voxels"), F.countDistinct("volume", "pred").alias("objects"))


@query(f"WITH {VOX} SELECT lin, x, y, z, truth, pred FROM vox WHERE x >= 2 AND x < (SELECT max(x) FROM vox) AND y >= 5 AND y < 20 AND z >= 3 AND z < 17")
def region_crop(spark, sf_dir):
    return labels.crop(v.voxels(spark, sf_dir), {"x": 2, "y": 5, "z": 3}, {"x": v.planes(spark, sf_dir) - 1, "y": 20, "z": 17}).select("lin", "x", "y", "z", "truth", "pred")


@query(f"""WITH {BOX} SELECT box, {', '.join(f'greatest(lo{i}, 100) AS low{i}, least(hi{i}, 900) AS high{i}' for i in range(3))},
{' AND '.join(f'lo{i} >= 100 AND hi{i} <= 900' for i in range(3))} AS whole FROM box WHERE {' AND '.join(f'greatest(lo{i}, 100) < least(hi{i}, 900)' for i in range(3))}""")
def region_intersection(spark, sf_dir):
    bounds = [(F.greatest(f"lo{i}", F.lit(100)), F.least(f"hi{i}", F.lit(900))) for i in range(3)]
    out = v.boxes(spark, sf_dir)
    whole = F.lit(True)
    for i, (low, high) in enumerate(bounds):
        out = out.withColumn(f"low{i}", low).withColumn(f"high{i}", high).filter(F.col(f"low{i}") < F.col(f"high{i}"))
        whole = whole & (F.col(f"lo{i}") >= 100) & (F.col(f"hi{i}") <= 900)
    return out.select("box", *(f"{e}{i}" for i in range(3) for e in ("low", "high")), whole.alias("whole"))


@query(f"WITH {VOX} SELECT lin, CASE WHEN (x + y + z) % 3 <> 0 THEN pred ELSE 0 END AS pred FROM vox")
def mask_labels(spark, sf_dir):
    return labels.mask(v.voxels(spark, sf_dir), "pred", (F.col("x") + F.col("y") + F.col("z")) % 3 != 0).select("lin", "pred")


@query(f"""WITH {VOX}, o(dx, dy, dz) AS (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)),
e1 AS (SELECT DISTINCT a.lin FROM vox a, o JOIN vox b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz WHERE a.truth <> b.truth)
SELECT lin, CASE WHEN lin IN (SELECT lin FROM e1) THEN 0 ELSE truth END AS truth FROM vox""")
def erode(spark, sf_dir):
    return labels.erode(v.voxels(spark, sf_dir), "truth").select("lin", "truth")


@query(f"""WITH {VOX}, d AS (SELECT range - 2 AS d FROM range(5)), o AS (SELECT a.d AS dx, b.d AS dy, c.d AS dz, a.d * a.d + b.d * b.d + c.d * c.d AS d2 FROM d a, d b, d c WHERE d2 > 0 AND d2 <= 4),
f AS (SELECT a.lin, arg_min(b.pred, d2 * 1000000000 + b.lin) AS near FROM vox a, o JOIN vox b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz WHERE a.pred = 0 AND b.pred <> 0 GROUP BY a.lin)
SELECT lin, coalesce(near, pred) AS pred FROM vox LEFT JOIN f USING (lin)""")
def fill_bounded(spark, sf_dir):
    return labels.fill(v.voxels(spark, sf_dir), "pred", 2).select("lin", "pred")


def _fill_far_sql(within: str, same: str) -> str:
    d2 = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
    return f"""WITH {VOX}, f AS (SELECT a.lin, arg_min(b.pred, {d2} * 1000000000 + b.lin) AS near FROM vox a JOIN vox b ON {same} WHERE a.pred = 0 AND b.pred <> 0 AND {d2} <= {within} GROUP BY a.lin)
SELECT lin, coalesce(near, pred) AS pred FROM vox LEFT JOIN f USING (lin)"""


@query(_fill_far_sql("1e18", "a.volume = b.volume"))
def fill_all(spark, sf_dir):
    """Every background voxel takes its volume's nearest segment."""
    return labels.fill(v.voxels(spark, sf_dir), "pred", "all", by=["volume"]).select("lin", "pred")


@query(_fill_far_sql("20.25", "b.x BETWEEN a.x - 4 AND a.x + 4 AND b.y BETWEEN a.y - 4 AND a.y + 4"))
def fill_far(spark, sf_dir):
    """As ``fill_bounded``, at a distance for which lines are swept."""
    return labels.fill(v.voxels(spark, sf_dir), "pred", 4.5).select("lin", "pred")


SCORES_SQL = "emb AS (SELECT vec_id, embedding AS s FROM embeddings)"


@query(f"WITH {SCORES_SQL} SELECT vec_id, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS class FROM emb")
def argmax_class(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", labels.argmax(F.col("embedding")).alias("class"))


@query(f"WITH {SCORES_SQL} SELECT vec_id, CASE WHEN list_max(s) >= 0.25 THEN CAST(list_position(s, list_max(s)) - 1 AS INTEGER) ELSE -1 END AS class FROM emb")
def per_class_threshold(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", labels.class_above(F.col("embedding"), 0.25, -1).alias("class"))


# -- class maps -----------------------------------------------------------------------------------------------
CONF = f"{CLS}, conf AS (SELECT volume, truth, CASE WHEN pred BETWEEN 0 AND 7 THEN pred ELSE -1 END AS pred, count(*) AS n FROM cls WHERE truth <> 0 GROUP BY ALL)"


@query(f"WITH {CONF} SELECT * FROM conf")
def confusion(spark, sf_dir):
    return metrics.confusion(v.class_map(spark, sf_dir), 8, by=["volume"])


def _scores_sql(by: str) -> str:
    b = f"{by}, " if by else ""
    using = f"USING ({b}name)"
    return f"""{CONF}, {v.CLASSES_SQL}, a AS (SELECT {b}name, sum(n) AS actual FROM conf JOIN classes ON truth = id GROUP BY ALL), p AS (SELECT {b}name, sum(n) AS predicted FROM conf JOIN classes ON pred = id GROUP BY ALL),
h AS (SELECT {b}c.name, sum(n) AS hit FROM conf JOIN classes c ON truth = c.id JOIN classes d ON pred = d.id AND c.name = d.name GROUP BY ALL),
sc AS (SELECT {b}name, CAST(coalesce(hit, 0) AS BIGINT) AS hit, CAST(actual AS BIGINT) AS actual, CAST(coalesce(predicted, 0) AS BIGINT) AS predicted FROM a LEFT JOIN p {using} LEFT JOIN h {using})"""


@query(f"WITH {_scores_sql('')} SELECT *, round(hit / (actual + predicted - hit), 9) AS iou, round(2 * hit / (actual + predicted), 9) AS dice FROM sc")
def semantic_composites(spark, sf_dir):
    return metrics.class_scores(cut(metrics.confusion(v.class_map(spark, sf_dir), 8), "confusion"), v.CLASSES)


@query(f"WITH {_scores_sql('volume')} SELECT volume, round(avg(hit / (actual + predicted - hit)), 6) AS mean_iou, round(avg(2 * hit / (actual + predicted)), 6) AS mean_dice, count(*) AS n_classes FROM sc GROUP BY volume")
def semantic_iou(spark, sf_dir):
    scores = metrics.class_scores(cut(metrics.confusion(v.class_map(spark, sf_dir), 8, by=["volume"]), "confusion"), v.CLASSES, ["volume"])
    exact = {"iou": F.col("hit") / (F.col("actual") + F.col("predicted") - F.col("hit")), "dice": 2 * F.col("hit") / (F.col("actual") + F.col("predicted"))}
    return scores.groupBy("volume").agg(*(F.round(F.avg(e), 6).alias(f"mean_{k}") for k, e in exact.items()), F.count("*").alias("n_classes"))


@query(f"WITH {CONF} SELECT volume, CAST(sum(n) AS BIGINT) AS total, round(sum(n) FILTER (truth = pred) / sum(n), 9) AS accuracy, CAST(sum(n) FILTER (pred = -1) AS BIGINT) AS overflow FROM conf GROUP BY ROLLUP (volume)")
def semantic_pooled(spark, sf_dir):
    conf = metrics.confusion(v.class_map(spark, sf_dir), 8, by=["volume"])
    hit = F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")))
    return conf.rollup("volume").agg(F.sum("n").alias("total"), F.round(hit / F.sum("n"), 9).alias("accuracy"), F.sum(F.when(F.col("pred") == -1, F.col("n"))).alias("overflow"))


@query(f"WITH {CLS} SELECT truth, {', '.join(f'count(*) FILTER (volume = {i}) AS v{i}' for i in range(4))}, count(*) AS total FROM cls GROUP BY truth")
def class_presence_pivot(spark, sf_dir):
    rows = v.class_map(spark, sf_dir).groupBy("truth").agg(*(F.count_if(F.col("volume") == i).alias(f"v{i}") for i in range(4)), F.count("*").alias("total"))
    return rows


@query("""WITH classes(name, ids) AS (VALUES ('c1', [1]), ('c2', [2]), ('c4', [4]), ('c5', [5]), ('c6', [6]), ('ret', [1, 4]), ('open', [4, 5, 6])),
used AS (SELECT DISTINCT l_linenumber AS id FROM lineitem), own AS (SELECT name, list_sort(list(id)) AS leaves FROM (SELECT name, unnest(ids) AS id FROM classes) JOIN used USING (id) GROUP BY name)
SELECT a.name, array_to_string(list_sort(list(b.name)), ',') AS holds FROM own a JOIN own b ON list_has_all(a.leaves, b.leaves) GROUP BY a.name""")
def class_closure(spark, sf_dir):
    """Classes whose ids (of those that the table uses) all belong to another class."""
    used = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("id")).distinct()
    listed = {n: ids for n, ids in v.CLASSES.items() if n != "c3"}
    rows = spark.createDataFrame([(n, i) for n, ids in listed.items() for i in ids], "name string, id int")
    leaves = F.broadcast(rows).join(used, "id").groupBy("name").agg(F.collect_set("id").alias("leaves"))
    a, b = leaves.select("name", "leaves"), leaves.select(F.col("name").alias("other"), F.col("leaves").alias("parts"))
    held = a.crossJoin(F.broadcast(b)).filter(F.size(F.array_except("parts", "leaves")) == 0)  # a row a class
    return held.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("other")), ",").alias("holds"))


# -- affinity graphs ------------------------------------------------------------------------------------------
EXTENT = "ext AS (SELECT max(event_id) // 500 + 1 AS sx FROM events)"


def _edges_sql(stride: int = 1) -> str:
    parts = []
    for i, (axis, size, step) in enumerate((("x", "sx", 500), ("y", "25", 20), ("z", "20", 1)) * 2):
        reach = 1 if i < 3 else 10
        grid = "" if i < 3 or stride == 1 else f" AND x % {stride} = 0 AND y % {stride} = 0 AND z % {stride} = 0"
        parts.append(f'SELECT volume, lin AS src, lin + {reach * step} AS dst, {i} AS "offset", {"a" if i < 3 else "1 - a"}{i} AS priority, {"true" if i < 3 else "false"} AS attractive FROM aff, ext WHERE {axis} + {reach} < {size}{grid}')
    return f"{VOX}, {AFF}, {EXTENT}, edge AS ({' UNION ALL '.join(parts)})"


def _edges(spark, sf_dir, stride: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    shape = {"x": v.planes(spark, sf_dir), "y": v.SHAPE_Y, "z": v.SHAPE_Z}
    return graph.edges(v.affinities(spark, sf_dir), shape, v.STRIDES, stride, list(keep))


@query(f'WITH {_edges_sql()} SELECT src, dst, "offset", priority, attractive FROM edge')
def edges_build(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(f'WITH {_edges_sql()} SELECT "offset", count(*) AS n, round(sum(priority), 6) AS total FROM edge GROUP BY "offset"')
def edges_count(spark, sf_dir):
    return _edges(spark, sf_dir).groupBy("offset").agg(F.count("*").alias("n"), F.round(F.sum("priority"), 6).alias("total"))


@query(f'WITH {_edges_sql(2)} SELECT "offset", count(*) AS n, round(sum(priority), 6) AS total FROM edge GROUP BY "offset"')
def edges_stride(spark, sf_dir):
    return _edges(spark, sf_dir, 2).groupBy("offset").agg(F.count("*").alias("n"), F.round(F.sum("priority"), 6).alias("total"))


@query(f'WITH {_edges_sql()} SELECT src, "offset", priority, row_number() OVER (ORDER BY priority DESC, "offset", src) AS place FROM edge QUALIFY place <= 1000')
def edge_order_top(spark, sf_dir):
    """The first thousand edges in the watershed's order: a top-k report."""
    top = _edges(spark, sf_dir).select("src", "offset", "priority").orderBy(F.desc("priority"), "offset", "src").limit(1000)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("priority"), "offset", "src")))


@query(f'WITH {_edges_sql()} SELECT CAST(least(floor((1 - priority) * 256), 255) AS BIGINT) AS band, count(*) AS n, min(priority) AS low, max(priority) AS high FROM edge GROUP BY band')
def edge_bands(spark, sf_dir):
    band = F.least(F.floor((1 - F.col("priority")) * 256), F.lit(255)).cast("long")
    return _edges(spark, sf_dir).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.min("priority").alias("low"), F.max("priority").alias("high"))


@query(f'WITH {_edges_sql()}, m AS (SELECT lin FROM aff WHERE (x + y) % 4 <> 0) SELECT "offset", count(*) AS n FROM edge WHERE src IN (SELECT lin FROM m) AND dst IN (SELECT lin FROM m) GROUP BY "offset"')
def masked_edges(spark, sf_dir):
    inside = v.lattice(spark, sf_dir).filter((F.col("x") + F.col("y")) % 4 != 0).select("lin")
    out = _edges(spark, sf_dir).join(inside.withColumnRenamed("lin", "src"), "src", "left_semi").join(inside.withColumnRenamed("lin", "dst"), "dst", "left_semi")
    return out.groupBy("offset").agg(F.count("*").alias("n"))


GT_SQL = f"""{VOX}, {AFF}, gt AS (SELECT a.lin, o.c, CASE WHEN a.truth > 0 AND a.truth = b.truth THEN 1 ELSE 0 END AS gt
FROM vox a CROSS JOIN (VALUES (0, 1, 0, 0), (1, 0, 1, 0), (2, 0, 0, 1)) o(c, dx, dy, dz) LEFT JOIN vox b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz)"""


def _true_affinities(spark, sf_dir) -> DataFrame:
    """lin, c, gt: whether a voxel and the next one along axis c are in one object."""
    vox = v.voxels(spark, sf_dir)
    steps = F.array(*(F.struct(F.lit(i).alias("c"), *(F.lit(int(a == b)).alias(f"d{b}") for b in "xyz")) for i, a in enumerate("xyz")))
    ends = vox.select("lin", F.col("truth").alias("own"), "x", "y", "z", F.explode(steps).alias("o"))
    ends = ends.select("lin", "own", "o.c", *((F.col(a) + F.col(f"o.d{a}")).alias(a) for a in "xyz"))
    out = ends.join(vox.select("x", "y", "z", "truth"), ["x", "y", "z"], "left")
    return out.select("lin", "c", F.when((F.col("own") > 0) & (F.col("own") == F.col("truth")), 1).otherwise(0).alias("gt"))


@query(f"WITH {GT_SQL} SELECT c, CAST(sum(gt) AS BIGINT) AS joined, count(*) AS n FROM gt GROUP BY c")
def gt_affinity(spark, sf_dir):
    return _true_affinities(spark, sf_dir).groupBy("c").agg(F.sum("gt").alias("joined"), F.count("*").alias("n"))


@query(f"""WITH {GT_SQL}, s AS (SELECT c, gt, CASE c WHEN 0 THEN a0 WHEN 1 THEN a1 ELSE a2 END AS a FROM gt JOIN aff USING (lin))
SELECT c, round(avg(a) FILTER (gt = 1), 9) AS inside, round(avg(a) FILTER (gt = 0), 9) AS across, round(avg(a) FILTER (gt = 1) - avg(a) FILTER (gt = 0), 9) AS separation FROM s GROUP BY c""")
def affinity_separation(spark, sf_dir):
    rows = _true_affinities(spark, sf_dir).join(v.affinities(spark, sf_dir).select("lin", F.array("a0", "a1", "a2").alias("a")), "lin")
    a = F.get("a", F.col("c"))
    inside, across = F.avg(F.when(F.col("gt") == 1, a)), F.avg(F.when(F.col("gt") == 0, a))
    return rows.groupBy("c").agg(F.round(inside, 9).alias("inside"), F.round(across, 9).alias("across"), F.round(inside - across, 9).alias("separation"))


COMPONENTS_SQL = f"""{VOX}, {AFF}, {EXTENT}, th AS (SELECT lin, x, y, z, a0 > 1 / (1 + exp(-1.4)) AS p0, a1 > 1 / (1 + exp(-1.4)) AS p1, a2 > 1 / (1 + exp(-1.4)) AS p2 FROM aff),
ln AS (SELECT lin AS a, lin + 500 AS b FROM th, ext WHERE p0 AND x + 1 < sx UNION ALL SELECT lin, lin + 20 FROM th WHERE p1 AND y + 1 < 25 UNION ALL SELECT lin, lin + 1 FROM th WHERE p2 AND z + 1 < 20),
sy AS (SELECT a, b FROM ln UNION ALL SELECT b, a FROM ln), nd AS (SELECT lin FROM th WHERE p0 OR p1 OR p2 UNION SELECT b FROM ln),
re AS (SELECT lin AS node, lin AS root FROM nd UNION SELECT b, root FROM re JOIN sy ON node = a WHERE root < b),
ro AS (SELECT node, min(root) AS root FROM re GROUP BY node), lb AS (SELECT node AS lin, dense_rank() OVER (ORDER BY root) AS label FROM ro)"""


def _components(spark, sf_dir) -> DataFrame:
    return graph.threshold_components(v.affinities(spark, sf_dir), 7, {"x": v.planes(spark, sf_dir), "y": v.SHAPE_Y, "z": v.SHAPE_Z}, v.STRIDES)


@query(f"WITH RECURSIVE {COMPONENTS_SQL} SELECT lin, CAST(coalesce(label, 0) AS BIGINT) AS label FROM th LEFT JOIN lb USING (lin)")
def connected_components(spark, sf_dir):
    return _components(spark, sf_dir)


@query(f"WITH RECURSIVE {COMPONENTS_SQL}, s AS (SELECT label, count(*) AS size FROM lb GROUP BY label) SELECT size, count(*) AS n FROM s GROUP BY size")
def component_sizes(spark, sf_dir):
    sizes = _components(spark, sf_dir).filter("label <> 0").groupBy("label").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("n"))


def _pieces(spark, sf_dir) -> DataFrame:
    shape = {"x": v.planes(spark, sf_dir), "y": v.SHAPE_Y, "z": v.SHAPE_Z}
    return graph.same_label_components(v.voxels(spark, sf_dir), "pred", shape, v.STRIDES)


PIECES_SQL = f"""{VOX}, nb AS (SELECT a.lin AS a, b.lin AS b FROM vox a CROSS JOIN (VALUES (1, 0, 0), (0, 1, 0), (0, 0, 1)) o(dx, dy, dz) JOIN vox b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz WHERE a.pred = b.pred AND a.pred <> 0),
sy AS (SELECT a, b FROM nb UNION ALL SELECT b, a FROM nb), re AS (SELECT lin AS node, lin AS root FROM vox WHERE pred <> 0 UNION SELECT b, root FROM re JOIN sy ON node = a WHERE root < b),
pc AS (SELECT node AS lin, min(root) AS piece FROM re GROUP BY node)"""


@query(f"WITH RECURSIVE {PIECES_SQL} SELECT lin, pred, piece FROM pc JOIN vox USING (lin)")
def same_label_components(spark, sf_dir):
    return _pieces(spark, sf_dir)


@query(f"WITH RECURSIVE {PIECES_SQL}, s AS (SELECT pred, piece, count(*) AS n FROM pc JOIN vox USING (lin) GROUP BY ALL) SELECT pred, piece, n FROM s QUALIFY row_number() OVER (PARTITION BY pred ORDER BY n DESC, piece) = 1")
def largest_piece(spark, sf_dir):
    sizes = _pieces(spark, sf_dir).groupBy("pred", "piece").agg(F.count("*").alias("n"))
    return sizes.groupBy("pred").agg(F.min_by(F.struct("piece", "n"), F.struct(-F.col("n"), "piece")).alias("b")).select("pred", "b.piece", "b.n")


def _volume_edges(spark, sf_dir, planes: int = v.DEPTH) -> DataFrame:
    size = planes * v.STRIDES["x"]
    edges = _edges(spark, sf_dir, keep=("volume",)).withColumn("volume", v.div("src", size))
    return edges.filter(v.div("dst", size) == F.col("volume"))


def _deep_lattice(spark, sf_dir) -> DataFrame:
    return v.lattice(spark, sf_dir).withColumn("volume", v.div("x", v.DEPTH))


@query()
def mutex_watershed(spark, sf_dir):
    return mws.mutex_watershed(_deep_lattice(spark, sf_dir).select("volume", "lin"), _volume_edges(spark, sf_dir))


@query()
def mws_segments(spark, sf_dir):
    found = mws.mutex_watershed(_deep_lattice(spark, sf_dir).select("volume", "lin"), _volume_edges(spark, sf_dir))
    sizes = found.groupBy("volume", "segment").agg(F.count("*").alias("n"))
    return sizes.groupBy("volume").agg(F.count("*").alias("segments"), F.max("n").alias("largest"))


def _block():
    return (F.col("volume") * 4 + F.floor(F.col("y") / 13) * 2 + F.floor(F.col("z") / 10)).cast("long")


@query()
def mws_blockwise(spark, sf_dir):
    return mws.blockwise(_deep_lattice(spark, sf_dir).select("volume", "lin", "y", "z"), _volume_edges(spark, sf_dir), _block())


@query(f"""WITH {_edges_sql()}, l AS (SELECT lin, x // {v.DEPTH} AS volume, y, z, truth AS cluster, x // {v.DEPTH} * 4 + y // 13 * 2 + z // 10 AS block FROM vox),
c AS (SELECT p.volume, least(p.cluster, q.cluster) AS low, greatest(p.cluster, q.cluster) AS high, priority, "offset", src, attractive FROM edge e JOIN l p ON src = p.lin JOIN l q ON dst = q.lin WHERE p.block <> q.block AND p.volume = q.volume)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY volume, low, high ORDER BY priority DESC, "offset", src) = 1""")
def face_pairs(spark, sf_dir):
    placed = v.voxels(spark, sf_dir).withColumn("volume", v.div("x", v.DEPTH)).select("lin", F.col("truth").alias("cluster"), _block().alias("block"))
    return mws.face_pairs(_volume_edges(spark, sf_dir), placed)


def _deep_boxes(spark, sf_dir) -> DataFrame:
    box = [f(a).alias(f"{e}{a}") for a in "xyz" for e, f in (("low", F.min), ("last", F.max))]
    return _deep_lattice(spark, sf_dir).groupBy("volume").agg(*box).select("volume", *(c for a in "xyz" for c in (f"low{a}", (F.col(f"last{a}") + 1).alias(f"high{a}"))))


TILES = {"x": 10, "y": 12, "z": 10}
BLOCKS_SQL = f"""{VOX}, bx AS (SELECT x // {v.DEPTH} AS volume, {', '.join(f'min({a}) AS low{a}, max({a}) + 1 AS high{a}' for a in 'xyz')} FROM vox GROUP BY ALL),
{', '.join(f'k{a} AS (SELECT volume, unnest(range(0, CAST(ceil((high{a} - low{a}) / {n}.0) AS BIGINT))) AS i{a} FROM bx)' for a, n in TILES.items())},
bl AS (SELECT volume, (ix * {1 << tiling.BITS} + iy) * {1 << tiling.BITS} + iz AS block, ix, iy, iz, {', '.join(f'low{a} + i{a} * {n} AS low{a}, least(low{a} + i{a} * {n} + {n}, high{a}) AS high{a}' for a, n in TILES.items())} FROM bx JOIN kx USING (volume) JOIN ky USING (volume) JOIN kz USING (volume))"""


@query(f"WITH {BLOCKS_SQL} SELECT * FROM bl")
def block_tiling(spark, sf_dir):
    """The blocks of every volume, multiples of a stride and a grain of 2."""
    return tiling.blocks(_deep_boxes(spark, sf_dir), tuple(TILES.values()), stride=2, grain=2)


@query(f"""WITH {BLOCKS_SQL} SELECT p.volume, p.block, axis, q.block AS "next" FROM bl p CROSS JOIN (VALUES ('x', 1, 0, 0), ('y', 0, 1, 0), ('z', 0, 0, 1)) s(axis, dx, dy, dz) JOIN bl q ON q.volume = p.volume AND q.ix = p.ix + dx AND q.iy = p.iy + dy AND q.iz = p.iz + dz""")
def block_neighbours(spark, sf_dir):
    return tiling.neighbours(tiling.blocks(_deep_boxes(spark, sf_dir), tuple(TILES.values()), stride=2, grain=2))


@query()
def mws_tiled(spark, sf_dir):
    """Mutex watershed of volumes of twenty planes, by blocks and up the tree of blocks."""
    edges = _edges(spark, sf_dir, keep=("volume", "x", "y", "z")).withColumn("volume", v.div("x", v.DEPTH))
    edges = edges.filter(v.div("dst", v.DEPTH * v.STRIDES["x"]) == F.col("volume"))
    return mws.tiled(_deep_lattice(spark, sf_dir).select("volume", "lin", "x", "y", "z"), edges, tuple(TILES.values()), lows={"x": F.col("volume") * v.DEPTH})


# -- grids and boxes ------------------------------------------------------------------------------------------
@query(f"""WITH {VOX}, m AS (SELECT lin, {', '.join(f'CAST(least(greatest(floor(({a} * 4.0 + 2.0 - 3.0) / 8.0 + 0.5 + 0.000001), 0), {s}) AS BIGINT) AS g{a}' for a, s in (('x', 'sx - 1'), ('y', '24'), ('z', '19')))} FROM vox, (SELECT max(x) + 1 AS sx FROM vox))
SELECT m.lin, vox.pred AS aligned FROM m JOIN vox ON x = gx AND y = gy AND z = gz""")
def grid_align(spark, sf_dir):
    """Labels on a grid of half the step take the prediction voxel that holds their centre."""
    vox = v.voxels(spark, sf_dir)
    shape = {"x": v.planes(spark, sf_dir), "y": v.SHAPE_Y, "z": v.SHAPE_Z}
    at = vox.select("lin", *(grids.aligned(F.col(a) * 4.0 + 2.0, 3.0, 8.0, n).alias(a) for a, n in shape.items()))
    return at.join(vox.select("x", "y", "z", F.col("pred").alias("aligned")), ["x", "y", "z"]).select("lin", "aligned")


OVERLAP_SQL = f"{BOX}, ov AS (SELECT a.box AS a, b.box AS b FROM box a JOIN box b ON a.store = b.store AND a.box < b.box AND {' AND '.join(f'greatest(a.lo{i}, b.lo{i}) < least(a.hi{i}, b.hi{i})' for i in range(3))})"


@query(f"WITH {OVERLAP_SQL} SELECT a, b FROM ov")
def box_overlaps(spark, sf_dir):
    return grids.overlaps(v.boxes(spark, sf_dir), 128)


@query(f"WITH RECURSIVE {OVERLAP_SQL}, sy AS (SELECT a, b FROM ov UNION ALL SELECT b, a FROM ov), re AS (SELECT box AS node, box AS root FROM box UNION SELECT b, root FROM re JOIN sy ON node = a WHERE root < b) SELECT node AS box, min(root) AS leader, dense_rank() OVER (ORDER BY min(root)) AS number FROM re GROUP BY node")
def overlap_groups(spark, sf_dir):
    return grids.overlap_groups(v.boxes(spark, sf_dir), 128)


# -- skeletons ------------------------------------------------------------------------------------------------
@query(f"WITH {VOX}, {SKEL} SELECT node, skel, seg, pred FROM nodes LEFT JOIN vox ON lin = node")
def node_lookup(spark, sf_dir):
    """Every node takes the label of the voxel that it lies in; null outside of the volume."""
    nodes, vox = v.skeleton_nodes(spark, sf_dir), v.voxels(spark, sf_dir).select("lin", "pred")
    return nodes.join(vox, nodes["node"] == vox["lin"], "left").select("node", "skel", "seg", "pred")


@query(f"""WITH {SKEL}, cont AS (SELECT skel AS truth, seg AS pred, count(*) AS n FROM nodes GROUP BY ALL), t AS (SELECT truth, sum(n) AS t FROM cont GROUP BY truth), p AS (SELECT pred, sum(n) AS p FROM cont GROUP BY pred), a AS (SELECT sum(n) AS a FROM cont),
s AS (SELECT greatest(-sum(n / a * log2(n / t)), 0.0) AS split, greatest(-sum(n / a * log2(n / p)), 0.0) AS merge FROM cont JOIN t USING (truth) JOIN p USING (pred), a)
SELECT round(split, 9) AS voi_split, round(merge, 9) AS voi_merge, round(split + merge, 9) AS voi_sum FROM s""")
def skeleton_voi(spark, sf_dir):
    nodes = v.skeleton_nodes(spark, sf_dir).select(F.col("skel").alias("truth"), F.col("seg").alias("pred"))
    return metrics.variation_of_information(_contingency(nodes))


def _kinds_sql(size: int = 0) -> str:
    return f"""{SKEL}, pr AS (SELECT skel, seg, count(*) AS n FROM nodes GROUP BY ALL HAVING n > {size}), mg AS (SELECT seg FROM pr WHERE seg <> 0 GROUP BY seg HAVING count(*) > 1), ms AS (SELECT DISTINCT skel FROM pr WHERE seg IN (SELECT seg FROM mg)),
kinds AS (SELECT *, CASE WHEN seg_u = 0 OR seg_v = 0 THEN 'omitted' WHEN seg_u <> seg_v THEN 'split' WHEN skel IN (SELECT skel FROM ms) AND seg_u IN (SELECT seg FROM mg) THEN 'merged' ELSE 'correct' END AS kind FROM edges)"""


def _skeletons(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    nodes = v.skeleton_nodes(spark, sf_dir)
    return v.skeleton_edges(nodes), nodes


@query(f"WITH {_kinds_sql()} SELECT kind, count(*) AS n, round(sum(length), 6) AS length FROM kinds GROUP BY kind")
def edge_classes(spark, sf_dir):
    edges, nodes = _skeletons(spark, sf_dir)
    return skeletons.classified(edges, nodes).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("length"), 6).alias("length"))


def _erl_sql(size: int) -> str:
    return f"""WITH {_kinds_sql(size)}, o AS (SELECT sum(l * l) AS q FROM (SELECT sum(length) AS l FROM kinds WHERE kind = 'correct' GROUP BY skel, seg_u)), m AS (SELECT sum(l * l) AS w FROM (SELECT sum(length) AS l FROM edges GROUP BY skel)), t AS (SELECT sum(length) AS t FROM edges)
SELECT round(coalesce(q, 0) / t, 6) AS erl, round(w / t, 6) AS max_erl, round(coalesce(q, 0) / w, 9) AS nerl FROM o, m, t"""


@query(_erl_sql(0))
def skeleton_erl(spark, sf_dir):
    return skeletons.expected_run_length(*_skeletons(spark, sf_dir))


@query(" UNION ALL ".join(f"SELECT {s} AS ignored_size, * FROM ({_erl_sql(s)})" for s in (0, 1, 2, 5)))
def adapted_nerl(spark, sf_dir):
    edges, nodes = _skeletons(spark, sf_dir)
    rows = [skeletons.expected_run_length(edges, nodes, s).withColumn("ignored_size", F.lit(s)) for s in (0, 1, 2, 5)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query(f"""WITH {_kinds_sql()}, s AS (SELECT seg, count(DISTINCT skel) AS k FROM nodes GROUP BY seg HAVING k > 1)
SELECT (SELECT CAST(coalesce(sum(k), 0) AS BIGINT) FROM s) AS n_mergers, (SELECT CAST(coalesce(sum(k), 0) AS BIGINT) FROM s WHERE seg <> 0) AS n_non0_mergers, (SELECT count(*) FROM kinds WHERE kind = 'split') AS n_splits""")
def merge_split_counts(spark, sf_dir):
    return skeletons.merge_split_counts(*_skeletons(spark, sf_dir))


@query(f"WITH {SKEL} SELECT skel, sum(length) AS cable, count(*) AS n_edges FROM edges GROUP BY skel")
def cable_length(spark, sf_dir):
    return skeletons.cable_length(_skeletons(spark, sf_dir)[0])


@query(f"""WITH {SKEL}, k AS (SELECT * FROM nodes WHERE pos >= 3 AND pos < 9) SELECT e.skel, u, v, p.pos - 3 AS pos_u, q.pos - 3 AS pos_v FROM edges e JOIN k p ON u = p.node JOIN k q ON v = q.node""")
def skeleton_crop(spark, sf_dir):
    """Edges with both ends inside the box, positions from its corner on."""
    edges, nodes = _skeletons(spark, sf_dir)
    inside = nodes.filter("pos >= 3 AND pos < 9")
    ends = {e: inside.select(F.col("node").alias(e), (F.col("pos") - 3).alias(f"pos_{e}")) for e in "uv"}
    return edges.join(ends["u"], "u").join(ends["v"], "v").select("skel", "u", "v", "pos_u", "pos_v")


# -- fitting and boards ---------------------------------------------------------------------------------------
SWEEP_SQL = f"""WITH {CONT_V}, sz AS (SELECT volume, pred, sum(n) AS size FROM cont GROUP BY ALL), g(ordinal, min_size) AS (VALUES (0, 0), (1, 20), (2, 40), (3, 60)),
c AS (SELECT ordinal, min_size, volume, truth, CASE WHEN size < min_size THEN 0 ELSE pred END AS pred, sum(n) AS n FROM cont JOIN sz USING (volume, pred), g GROUP BY ALL),
t AS (SELECT ordinal, volume, truth, sum(n) AS t FROM c GROUP BY ALL), p AS (SELECT ordinal, volume, pred, sum(n) AS p FROM c GROUP BY ALL),
m AS (SELECT ordinal, volume, count(*) AS tp, sum(n / (t + p - n)) AS s FROM c JOIN t USING (ordinal, volume, truth) JOIN p USING (ordinal, volume, pred) WHERE truth <> 0 AND pred <> 0 AND n / (t + p - n) > 0.5 GROUP BY ALL),
o AS (SELECT ordinal, min_size, volume, count(DISTINCT truth) FILTER (truth <> 0) AS nt, count(DISTINCT pred) FILTER (pred <> 0) AS np FROM c GROUP BY ALL),
q AS (SELECT ordinal, min_size, round(coalesce(s / tp * (tp / (tp + 0.5 * (np - tp) + 0.5 * (nt - tp))), 0), 9) AS pq FROM o LEFT JOIN m USING (ordinal, volume))
SELECT ordinal, min_size, round(avg(pq), 9) AS mean FROM q GROUP BY ordinal, min_size ORDER BY avg(pq) DESC, ordinal LIMIT 1"""


@query(SWEEP_SQL)
def fit_argmax(spark, sf_dir):
    swept = board.sweep_sizes(_contingency(v.voxels(spark, sf_dir), ["volume"]), [0, 20, 40, 60], ["volume"])
    scored = metrics.panoptic_quality(swept, by=["ordinal", "min_size", "volume"])
    return board.best_candidate(scored, "pq")


RANK_SQL = f"""{SUB}, rk AS (SELECT task, region, metric, row_number() OVER (PARTITION BY task, region, metric ORDER BY CASE WHEN metric = 'pq' THEN -coalesce(value, 0) ELSE coalesce(value, 0) END, ordinal) AS place, submission, value,
  coalesce(value = CASE WHEN metric = 'pq' THEN max(value) OVER w ELSE min(value) OVER w END, false) AS best FROM sub WINDOW w AS (PARTITION BY task, region, metric))"""


@query(f"WITH {RANK_SQL} SELECT * FROM rk")
def leaderboard_rank(spark, sf_dir):
    return board.ranked(v.submissions(spark, sf_dir))


@query(f"WITH {RANK_SQL} SELECT task, region, metric, submission, printf('%.4f', value) AS cell FROM rk WHERE best")
def best_in_column(spark, sf_dir):
    return board.ranked(v.submissions(spark, sf_dir)).filter("best").select("task", "region", "metric", "submission", board.cell("value").alias("cell"))


@query(f"WITH {SUB} SELECT task, array_to_string(list_sort(list(DISTINCT region)), '; ') AS regions, count(DISTINCT region) AS n_regions, count(*) AS n_rows FROM sub GROUP BY task")
def region_groups(spark, sf_dir):
    return board.region_groups(v.submissions(spark, sf_dir))


@query(f"""WITH {SUB}, a AS (SELECT ordinal, task, metric, value FROM sub WHERE metric = 'pq'), b AS (SELECT ordinal, task, metric, CASE WHEN ordinal % 5 = 0 THEN value + 1 ELSE value END AS value FROM sub WHERE ordinal % 3 <> 0),
d AS (SELECT coalesce(a.ordinal, b.ordinal) AS ordinal, CASE WHEN b.ordinal IS NULL THEN 'left' WHEN a.ordinal IS NULL THEN 'right' ELSE 'both' END AS side,
  array_to_string(list_filter([CASE WHEN a.task IS DISTINCT FROM b.task THEN 'task' END, CASE WHEN a.metric IS DISTINCT FROM b.metric THEN 'metric' END, CASE WHEN a.value IS DISTINCT FROM b.value THEN 'value' END], lambda x: x IS NOT NULL), ',') AS df FROM a FULL JOIN b ON a.ordinal = b.ordinal)
SELECT ordinal, side, CASE WHEN side = 'both' THEN df ELSE '' END AS differing FROM d WHERE side <> 'both' OR df <> ''""")
def identity_diff(spark, sf_dir):
    rows = v.submissions(spark, sf_dir)
    changed = rows.filter("ordinal % 3 <> 0").withColumn("value", F.when(F.col("ordinal") % 5 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return board.identity_diff(rows.filter("metric = 'pq'"), changed, "ordinal", ["task", "metric", "value"])


@query(f"WITH {SUB} SELECT metric, task, count(*) AS entries, count(value) AS scored, row_number() OVER (ORDER BY CASE metric WHEN 'pq' THEN 0 ELSE 1 END, task) AS place FROM sub GROUP BY metric, task")
def leaderboard_index(spark, sf_dir):
    index = v.submissions(spark, sf_dir).groupBy("metric", "task").agg(F.count("*").alias("entries"), F.count("value").alias("scored"))
    order = Window.orderBy(F.when(F.col("metric") == "pq", 0).otherwise(1), "task")  # a row a task
    return index.withColumn("place", F.row_number().over(order))


@query(f"WITH {SUB} SELECT a.region FROM (SELECT DISTINCT region FROM sub WHERE metric = 'pq') a JOIN (SELECT DISTINCT region FROM sub WHERE metric = 'voi') b USING (region)")
def volume_overlap_guard(spark, sf_dir):
    """Regions that both splits hold: none may be left where a fit and a test split must not meet."""
    rows = v.submissions(spark, sf_dir)
    return rows.filter("metric = 'pq'").select("region").intersect(rows.filter("metric = 'voi'").select("region"))


@query("SELECT n_name AS region FROM nation EXCEPT SELECT n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 5000")
def unknown_names(spark, sf_dir):
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier").filter("s_acctbal > 5000")
    known = n.join(s, n["n_nationkey"] == s["s_nationkey"]).select(F.col("n_name").alias("region"))
    return n.select(F.col("n_name").alias("region")).exceptAll(known.distinct()).distinct()


@query("""SELECT p_partkey AS part, 'identity(' || CASE WHEN p_size % 3 = 0 AND p_size % 4 = 0 THEN 'no filter' ELSE array_to_string(list_filter([CASE WHEN p_size % 3 > 0 THEN 'min_size=' || (p_size % 3) END, CASE WHEN p_size % 4 > 0 THEN 'fill_distance=' || (p_size % 4) END], lambda x: x IS NOT NULL), ', ') END || ')' AS described,
string_split('runs/' || p_brand, '/')[-1] || '.step' || p_size || '.' || lower(p_type) AS identifier FROM part""")
def setting_strings(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    name = run_identifier(F.concat(F.lit("runs/"), "p_brand"), F.col("p_size"), F.lower("p_type"))
    return rows.select(F.col("p_partkey").alias("part"), describe_filter(F.col("p_size") % 3, F.col("p_size") % 4).alias("described"), name.alias("identifier"))


@query("""WITH p AS (SELECT *, p_size % 3 AS m, p_size % 4 AS f, p_size % 12 - 2 AS g FROM part)
SELECT p_partkey AS part, CASE p_size % 3 WHEN 0 THEN 'cc_threshold(logit=' || CASE WHEN g < 0 THEN '' ELSE '+' END || g || ', thr=' || printf('%.4f', 1 / (1 + exp(-0.2 * g))) || CASE WHEN m > 0 THEN ', min_size=' || m ELSE '' END || CASE WHEN f > 0 THEN ', fill_distance=' || f ELSE '' END || ')'
WHEN 1 THEN 'mws(repulsive_stride=' || (g + 3) || CASE WHEN m > 0 THEN ', min_size=' || m ELSE '' END || CASE WHEN f > 0 THEN ', fill=' || f ELSE '' END || ')'
ELSE 'mws_blockwise(repulsive_stride=' || (g + 3) || ', block=[' || (g + 3) * 8 || ', 64, ' || p_size || ']' || CASE WHEN m > 0 THEN ', min_size=' || m ELSE '' END || ')' END AS described,
CASE WHEN p_size % 7 = 0 THEN p_brand ELSE CASE WHEN p_size % 5 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 'submission' ELSE lower(p_type) END ELSE p_brand END || CASE WHEN p_size % 11 = 0 THEN '' ELSE '.step' || p_size END || '.' || CASE WHEN p_size % 13 = 0 THEN 'unknown' ELSE 'route' END END AS identifier FROM p""")
def route_strings(spark, sf_dir):
    """Settings of every route in words, and identifiers where the run, the step or the route is not known."""
    size = F.col("p_size")
    m, f, g = size % 3, size % 4, size % 12 - 2
    described = F.when(size % 3 == 0, text.describe_threshold(g, m, f)).when(size % 3 == 1, text.describe_watershed(g + 3, F.lit(None).cast("array<int>"), m, f)).otherwise(text.describe_watershed(g + 3, F.array((g + 3) * 8, F.lit(64), size), m, f))
    run = F.when(size % 5 != 0, F.concat(F.lit("runs/"), "p_brand", F.lit("/")))
    name = text.run_identifier(
        run, F.when(size % 11 != 0, size), F.when(size % 13 != 0, "route"), F.when(size % 7 == 0, F.col("p_brand")), F.when(size % 2 != 0, F.concat(F.lit("a/b/"), F.lower("p_type"))), F.lit("")
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), described.alias("described"), name.alias("identifier"))


@query(f"""WITH {SUB}, k AS (SELECT task, region, count(*) AS n, min(ordinal) AS first FROM sub GROUP BY ALL)
SELECT task, string_agg(region || ' ' || CASE WHEN n % 4 = 0 THEN '?' ELSE n || 'x' || first END || CASE WHEN n % 3 = 0 THEN '' ELSE ' (sub-region)' END, '; ' ORDER BY region) AS key,
sha256('{{"volumes":[' || string_agg('{{"name":"' || region || '","label_key":' || CASE WHEN n % 2 = 0 THEN 'null' ELSE '"l' || n || '"' END || ',"bounding_box":[[0,' || n || '],[1,' || first || ']]}}', ',' ORDER BY region) || '],"metric":"voxel_instance","key":"pq","settings":{{"iou_threshold":0.5,"ignore":null}}}}') AS identity FROM k GROUP BY task""")
def task_records(spark, sf_dir):
    """Of every task the key of its regions and their extents, and the digest of its canonical identity."""
    rows = v.submissions(spark, sf_dir).groupBy("task", "region").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))
    shape = F.when(F.col("n") % 4 != 0, F.array("n", F.col("first").cast("long")))
    regions = F.collect_list(F.struct(F.col("region").alias("name"), shape.alias("shape"), (F.col("n") % 3 == 0).alias("whole")))
    box = F.array(F.array(F.lit(0).cast("long"), "n"), F.array(F.lit(1).cast("long"), F.col("first").cast("long")))
    truths = F.collect_list(F.struct(F.col("region").alias("name"), F.when(F.col("n") % 2 != 0, F.concat(F.lit("l"), F.col("n").cast("string"))).alias("label_key"), box.alias("bounding_box")))
    found = rows.groupBy("task").agg(regions.alias("regions"), truths.alias("truths"))  # regions of a task
    settings = F.struct(F.lit(0.5).alias("iou_threshold"), F.lit(None).cast("int").alias("ignore"))
    identity = text.task_identity(F.col("truths"), F.lit("voxel_instance"), F.lit("pq"), settings)
    return found.select("task", text.region_key(F.col("regions")).alias("key"), F.sha2(identity, 256).alias("identity"))


@query(f"WITH {SUB} SELECT task, sha256(string_agg(region || ' ' || n, '; ' ORDER BY region)) AS identity FROM (SELECT task, region, count(*) AS n FROM sub GROUP BY ALL) GROUP BY task")
def task_identity(spark, sf_dir):
    """A digest of a task's sorted regions and how many rows each has: equal tasks have equal digests."""
    counts = v.submissions(spark, sf_dir).groupBy("task", "region").agg(F.count("*").alias("n"))
    sorted_ = F.array_sort(F.collect_list(F.struct("region", "n")))
    shown = F.array_join(F.transform(sorted_, lambda r: F.concat_ws(" ", r["region"], r["n"].cast("string"))), "; ")
    return counts.groupBy("task").agg(F.sha2(shown, 256).alias("identity"))


# -- names, grids of settings, drift --------------------------------------------------------------------------
@query(f"""WITH {CLS}, {v.CLASSES_SQL}, s AS (SELECT name, count(*) AS n FROM classes GROUP BY name), b AS (SELECT id, c.name, row_number() OVER (PARTITION BY id ORDER BY n, c.name) AS k FROM classes c JOIN s ON c.name = s.name)
SELECT truth, name, count(*) AS n FROM cls JOIN b ON truth = id AND k = 1 GROUP BY ALL""")
def class_names(spark, sf_dir):
    """Every class id under the name of the smallest class that holds it."""
    rows = spark.createDataFrame([(n, i, len(ids)) for n, ids in v.CLASSES.items() for i in ids], "name string, id int, size int")
    names = rows.groupBy("id").agg(F.min_by("name", F.struct("size", "name")).alias("name"))
    counts = v.class_map(spark, sf_dir).groupBy("truth").agg(F.count("*").alias("n"))
    return counts.join(names, counts["truth"] == names["id"]).select("truth", "name", "n")


@query(f"""WITH {VOX}, m AS (SELECT lin, CAST(floor(x / 2.0) AS BIGINT) AS gx, CAST(floor(y / 2.0) AS BIGINT) AS gy, CAST(floor(z / 2.0) AS BIGINT) AS gz FROM vox),
k AS (SELECT x, y, z, truth > 0 AS inside FROM vox) SELECT vox.lin, CASE WHEN inside THEN pred ELSE 0 END AS pred FROM vox JOIN m USING (lin) JOIN k ON k.x = gx AND k.y = gy AND k.z = gz""")
def mask_grid(spark, sf_dir):
    """Labels under a mask of twice the step: the mask voxel that holds the label's corner decides, without slack."""
    vox = v.voxels(spark, sf_dir)
    inside = vox.select(*(F.col(a).alias(f"g{a}") for a in "xyz"), (F.col("truth") > 0).alias("inside"))
    at = vox.select("lin", "pred", *(v.div(a, 2).alias(f"g{a}") for a in "xyz"))
    return at.join(inside, ["gx", "gy", "gz"]).select("lin", F.when(F.col("inside"), F.col("pred")).otherwise(0).alias("pred"))


@query(f'WITH {_edges_sql()}, n AS (SELECT "offset", count(*) AS counted FROM edge GROUP BY "offset") SELECT "offset", counted, counted AS formula FROM n')
def edge_formula(spark, sf_dir):
    """Edges of each offset as counted, and as the extents of a full lattice give them."""
    edges = _edges(spark, sf_dir).groupBy("offset").agg(F.count("*").alias("counted"))
    planes, reach = v.planes(spark, sf_dir), F.when(F.col("offset") < 3, 1).otherwise(graph.REACH)
    axis = F.col("offset") % 3
    sizes = [planes, F.lit(v.SHAPE_Y), F.lit(v.SHAPE_Z)]
    full = [F.greatest(n - F.when(axis == i, reach).otherwise(0), F.lit(0)) for i, n in enumerate(sizes)]
    return edges.select("offset", "counted", (full[0] * full[1] * full[2]).cast("long").alias("formula"))


@query(f"WITH {VOX} SELECT volume, ordinal, logit, min_size FROM (SELECT DISTINCT volume FROM vox), (VALUES (0, 3, 0), (1, 3, 40), (2, 5, 0), (3, 5, 40)) g(ordinal, logit, min_size)")
def candidate_grid(spark, sf_dir):
    """All settings for every volume: sorted, without repeats, the logit outermost."""
    grid = spark.createDataFrame(board.candidates([40, 0, 40], [5, 3]), "ordinal int, logit int, min_size int")
    return v.voxels(spark, sf_dir).select("volume").distinct().crossJoin(F.broadcast(grid))


@query(f"""WITH {RANK_SQL}, now AS (SELECT task, region, metric, submission, place FROM rk), old AS (SELECT task, region, metric, submission, row_number() OVER (PARTITION BY task, region, metric ORDER BY ordinal) AS place FROM sub)
SELECT 'new' AS side, * FROM (SELECT * FROM now EXCEPT ALL SELECT * FROM old) UNION ALL SELECT 'old', * FROM (SELECT * FROM old EXCEPT ALL SELECT * FROM now)""")
def board_drift(spark, sf_dir):
    """Rows of a board that differ from an older one (in the order of arrival), both ways."""
    rows, columns = v.submissions(spark, sf_dir), ["task", "region", "metric", "submission", "place"]
    now = board.ranked(rows).select(*columns)
    arrival = F.row_number().over(Window.partitionBy("task", "region", "metric").orderBy("ordinal"))
    old = rows.withColumn("place", arrival).select(*columns)
    sides = [a.exceptAll(b).select(F.lit(n).alias("side"), *columns) for n, a, b in (("new", now, old), ("old", old, now))]
    return sides[0].unionByName(sides[1])


from . import checks as _checks  # noqa: E402, F401  (their queries join the catalogue)
from . import geometry as _geometry  # noqa: E402, F401
from . import plans as _plans  # noqa: E402, F401
from . import scoring as _scoring  # noqa: E402, F401
