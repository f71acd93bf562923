"""Queries of whole scoring jobs, guards and records; they join the catalogue when it is imported."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import board, metrics, scoring, skeletons
from ..sources import layout, records
from ..sources import volumes as v
from ..sources.storage import owned_path, table
from .catalog import BOX, CLS, CONF, CONT_V, SKEL, SUB, VOX, _pq_sql, query

# -- volumes --------------------------------------------------------------------------------------------------
C = "c AS (SELECT * FROM cont WHERE truth <> 0), t AS (SELECT volume, truth, sum(n) AS t FROM c GROUP BY ALL), p AS (SELECT volume, pred, sum(n) AS p FROM c GROUP BY ALL)"
VOI_V = f"""SELECT volume, round(split, 9) AS voi_split, round(merge, 9) AS voi_merge, round(split + merge, 9) AS voi_sum FROM (WITH {CONT_V}, {C}, a AS (SELECT volume, sum(n) AS a FROM c GROUP BY volume)
SELECT volume, greatest(-sum(n / a * log2(n / t)), 0.0) AS split, greatest(-sum(n / a * log2(n / p)), 0.0) AS merge FROM c JOIN t USING (volume, truth) JOIN p USING (volume, pred) JOIN a USING (volume) GROUP BY volume)"""
RAND_V = f"""WITH {CONT_V}, {C} SELECT volume, round(1 - 2 * nn / (tt + pp), 9) AS adapted_rand_error FROM (SELECT volume, sum(t * t::DOUBLE) AS tt FROM (SELECT volume, truth, t::BIGINT AS t FROM t) GROUP BY volume)
JOIN (SELECT volume, sum(p * p::DOUBLE) AS pp FROM (SELECT volume, pred, p::BIGINT AS p FROM p) GROUP BY volume) USING (volume) JOIN (SELECT volume, sum(n * n::DOUBLE) AS nn FROM c GROUP BY volume) USING (volume)"""


@query(f"""WITH {VOX}, b AS (SELECT volume, count(*) AS voxels, CASE WHEN volume % 3 = 1 THEN false ELSE true END AS whole_region FROM vox GROUP BY volume)
SELECT b.volume, voxels, whole_region, q.threshold AS iou_threshold, tp, fp, fn, sq, rq, pq, voi_split, voi_merge, voi_sum, adapted_rand_error
FROM b JOIN ({_pq_sql('volume', '(0.5::DOUBLE)', 'SELECT * FROM r')}) q USING (volume) JOIN ({VOI_V}) USING (volume) JOIN ({RAND_V}) USING (volume)""")
def score_volumes(spark, sf_dir):
    """Truth and prediction as two tables, bound by name and met by position; one contingency table for all metrics."""
    vox = v.voxels(spark, sf_dir)
    truth, prediction = vox.drop("pred"), vox.drop("truth")
    # of every three artifacts one declares a part, one the whole, and one nothing
    kind = F.col("volume") % 3
    artifacts = prediction.select("volume").distinct().withColumn("whole", F.when(kind == 1, False).when(kind == 2, True))
    return scoring.score_volumes(truth, prediction, artifacts)


def _laid_out(spark, sf_dir, *columns: str) -> list[str]:
    """The truth, the prediction or both (``columns``), written by blocks under names of their own."""
    vox, names = v.voxels(spark, sf_dir), [f"{c}_{uuid.uuid4().hex}" for c in columns]
    for name, column in zip(names, columns, strict=True):
        layout.write(vox.select(*layout.KEY, "x", "y", "z", column), name, layout.Layout((5, 10, 10)))
    return names


@query(f"""WITH {VOX} SELECT v.volume, true AS whole_region, q.threshold AS iou_threshold, tp, fp, fn, sq, rq, pq, voi_split, voi_merge, voi_sum, adapted_rand_error
FROM (SELECT DISTINCT volume FROM vox) v JOIN ({_pq_sql('volume', '(0.5::DOUBLE)', 'SELECT * FROM r')}) q USING (volume) JOIN ({VOI_V}) USING (volume) JOIN ({RAND_V}) USING (volume)""")
def score_layout(spark, sf_dir):
    """As ``score_volumes``, from tables that are laid out by blocks and meet without a shuffle."""
    return layout.scored(spark, *_laid_out(spark, sf_dir, "truth", "pred"))


@query(f"WITH {VOX} SELECT volume, lin, x, y, z, pred FROM vox WHERE volume % 2 = 0 AND x >= volume * 5 AND x < volume * 5 + 2 AND y >= 3 AND y < 12 AND z >= 9 AND z < 11")
def layout_regions(spark, sf_dir):
    """A box of every other volume, read from the blocks that it touches."""
    (name,) = _laid_out(spark, sf_dir, "pred")
    boxes = layout.extents(spark, name).filter("volume % 2 = 0").selectExpr("volume", "lowx", "lowx + 2 AS highx", "3L AS lowy", "12L AS highy", "9L AS lowz", "11L AS highz")
    return layout.regions(spark, name, boxes).select("volume", "lin", "x", "y", "z", "pred")


@query(f"""WITH {CONF}, a AS (SELECT truth, pred, sum(n) AS n FROM conf WHERE volume < 2 GROUP BY ALL), b AS (SELECT truth, pred, sum(n) AS n FROM conf WHERE volume >= 2 GROUP BY ALL)
SELECT truth, pred, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL""")
def confusion_merge(spark, sf_dir):
    """Confusion tables of two groups of volumes, made apart and added."""
    pixels = v.class_map(spark, sf_dir)
    return scoring.merged(*(metrics.confusion(pixels.filter(half), 8) for half in ("volume < 2", "volume >= 2")))


@query(f"WITH {CLS} SELECT coalesce(CAST(volume AS VARCHAR), 'all') AS split, truth, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY volume), 9) AS share FROM cls GROUP BY GROUPING SETS ((volume, truth), (truth))")
def class_shares(spark, sf_dir):
    """Voxels of each class and their share, by split and over all of them."""
    counts = v.class_map(spark, sf_dir).groupingSets([["volume", "truth"], ["truth"]], "volume", "truth").agg(F.count("*").alias("n"))
    share = F.round(F.col("n") / F.sum("n").over(Window.partitionBy("volume")), 9)  # a row a class
    return counts.select(F.coalesce(F.col("volume").cast("string"), F.lit("all")).alias("split"), "truth", "n", share.alias("share"))


@query("""WITH m AS (SELECT DISTINCT l_suppkey AS class, l_linenumber AS id FROM lineitem), leaves AS (SELECT class, list_sort(list(id)) AS ids FROM m GROUP BY class),
k AS (SELECT ids, list_sort(list(class)) AS same FROM leaves GROUP BY ids) SELECT a.ids[1] AS first_leaf, len(a.ids) AS n_leaves, sum(len(b.same))::BIGINT AS n_held, min(b.same[1]) AS least_held, len(a.same) AS n_classes
FROM k a JOIN k b ON list_has_all(a.ids, b.ids) GROUP BY a.ids, a.same""")
def class_ids(spark, sf_dir):
    """Composite classes from a table (suppliers as classes, line numbers as their leaves): those whose leaves are a subset.

    Classes of equal leaves are one set; there are at most 127 sets of 7 leaves, so the sets meet, not the classes.
    """
    leaves = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("class")).agg(F.array_sort(F.collect_set("l_linenumber")).alias("ids"))
    sets = leaves.groupBy("ids").agg(F.count("*").alias("n"), F.min("class").alias("least"))
    other = sets.select(F.col("ids").alias("_ids"), F.col("n").alias("_n"), F.col("least").alias("_least"))
    # a subset holds one of the set's leaves as its first one
    held = sets.withColumn("_first", F.explode("ids")).join(other.withColumn("_first", F.col("_ids")[0]), "_first").filter(F.size(F.array_except("_ids", "ids")) == 0)
    out = held.groupBy("ids", F.col("n").alias("n_classes")).agg(F.sum("_n").alias("n_held"), F.min("_least").alias("least_held"))
    return out.select(F.col("ids")[0].alias("first_leaf"), F.size("ids").cast("long").alias("n_leaves"), "n_held", "least_held", "n_classes")


@query("SELECT o_orderkey AS lin, o_custkey AS label FROM orders WHERE o_orderpriority = '2-HIGH'")
def label_frame(spark, sf_dir):
    """Labels of one pinned frame of a series (order priorities as frames): the pin reaches the scan."""
    return table(spark, sf_dir, "orders").filter("o_orderpriority = '2-HIGH'").select(F.col("o_orderkey").alias("lin"), F.col("o_custkey").alias("label"))


# -- skeletons ------------------------------------------------------------------------------------------------
STEP = (20, 9, 9)
IN_BOX = "node >= 0 AND node // 500 < (SELECT max(x) + 1 FROM vox) AND node // 20 % 25 BETWEEN 2 AND 22 AND node % 20 BETWEEN 1 AND 18"
LENGTH = f"sqrt(CAST({' + '.join(f'power((p.{a} - q.{a}) * {s}, 2)' for a, s in zip('xyz', STEP, strict=True))} AS DOUBLE)) / 1000"


def _skeletons_sql() -> str:
    parts, names, levels = [], [], (("0", ""), ("5", "_5"), ("20", "_20"), ("100", "_100"), ("1e300", "_inf"))
    for i, (size, name) in enumerate(levels):
        parts.append(f"""pr{i} AS (SELECT skel, seg FROM pairs WHERE n > {size} AND seg <> 0), mg{i} AS (SELECT seg FROM pr{i} GROUP BY seg HAVING count(*) > 1), ms{i} AS (SELECT DISTINCT skel FROM pr{i} WHERE seg IN (SELECT seg FROM mg{i})),
q{i} AS (SELECT coalesce(sum(l * l), 0) AS s{i} FROM (SELECT sum(length) AS l FROM e WHERE seg_u <> 0 AND seg_u = seg_v AND NOT (skel IN (SELECT skel FROM ms{i}) AND seg_u IN (SELECT seg FROM mg{i})) GROUP BY skel, seg_u))""")
        names.append(f"round(s{i} / most, 9) AS nerl{name}")
    return f"""WITH {VOX}, {SKEL}, nd AS (SELECT skel, node, node // 500 AS x, node // 20 % 25 AS y, node % 20 AS z, coalesce(pred, 0) AS seg FROM nodes LEFT JOIN vox ON lin = node WHERE {IN_BOX}),
e AS (SELECT edges.skel, p.seg AS seg_u, q.seg AS seg_v, {LENGTH} AS length FROM edges JOIN nd p ON u = p.node JOIN nd q ON v = q.node), pairs AS (SELECT skel, seg, count(*) AS n FROM nd GROUP BY ALL),
{', '.join(parts)}, mo AS (SELECT sum(l * l) AS most, sum(l) AS total, CAST(sum(k) AS BIGINT) AS n_edges FROM (SELECT sum(length) AS l, count(*) AS k FROM e GROUP BY skel)),
jo AS (SELECT seg, count(*) AS k FROM pairs GROUP BY seg HAVING k > 1), a AS (SELECT sum(n) AS a FROM pairs), t AS (SELECT skel, sum(n) AS t FROM pairs WHERE skel <> 0 GROUP BY skel), p AS (SELECT seg, sum(n) AS p FROM pairs GROUP BY seg),
vo AS (SELECT greatest(-sum(n / a * log2(n / t)), 0.0) AS split, greatest(-sum(n / a * log2(n / p)), 0.0) AS merge FROM pairs JOIN t USING (skel) JOIN p USING (seg), a)
SELECT (SELECT count(*) FROM nd) AS n_nodes, n_edges, round(s0 / total, 6) AS erl_um, round(most / total, 6) AS max_erl_um, {', '.join(names)}, (SELECT CAST(coalesce(sum(k), 0) AS BIGINT) FROM jo) AS n_mergers,
(SELECT CAST(coalesce(sum(k), 0) AS BIGINT) FROM jo WHERE seg <> 0) AS n_non0_mergers, (SELECT count(*) FROM e WHERE seg_u <> 0 AND seg_v <> 0 AND seg_u <> seg_v) AS n_splits, round(split, 9) AS voi_split, round(merge, 9) AS voi_merge
FROM mo, vo, {', '.join(f'q{i}' for i in range(len(levels)))}"""


@query(_skeletons_sql())
def score_skeletons(spark, sf_dir):
    """Skeletons cropped to a box, their nodes looked up in the prediction, lengths in micrometres, and all run lengths."""
    nodes = v.skeleton_nodes(spark, sf_dir)
    edges = v.skeleton_edges(nodes).select("skel", "u", "v")
    at = {"x": v.div("node", v.STRIDES["x"]), "y": v.div("node", v.SHAPE_Z) % v.SHAPE_Y, "z": F.col("node") % v.SHAPE_Z}
    placed = nodes.select("skel", "node", *(c.alias(a) for a, c in at.items()))
    inside = placed.filter((F.col("node") >= 0) & (F.col("x") < v.planes(spark, sf_dir)) & F.col("y").between(2, v.SHAPE_Y - 3) & F.col("z").between(1, v.SHAPE_Z - 2))
    vox = v.voxels(spark, sf_dir).select(F.col("lin").alias("node"), F.col("pred").alias("seg"))
    found = inside.join(vox, "node", "left").fillna(0, ["seg"])
    ends = {e: found.select(F.col("node").alias(e), F.col("seg").alias(f"seg_{e}"), *(F.col(a).alias(f"{a}_{e}") for a in "xyz")) for e in "uv"}
    length = F.sqrt(sum((F.pow((F.col(f"{a}_u") - F.col(f"{a}_v")) * s, F.lit(2)) for a, s in zip("xyz", STEP, strict=True)), F.lit(0.0))) / 1000
    kept = edges.join(ends["u"], "u").join(ends["v"], "v").select("skel", "u", "v", length.alias("length"), "seg_u", "seg_v")
    return scoring.score_skeletons(found.select("skel", "node", "seg"), kept)


@query(f"WITH {SKEL}, k AS (SELECT skel, sum(length) AS cable FROM edges GROUP BY skel) SELECT round(sum(cable * cable) / sum(cable), 6) AS perfect_erl, round(sum(cable), 6) AS total, count(*) AS skeletons FROM k")
def perfect_run_length(spark, sf_dir):
    return skeletons.perfect_run_length(v.skeleton_edges(v.skeleton_nodes(spark, sf_dir)))


# -- boards, records, guards ----------------------------------------------------------------------------------
#: A board's rows come from one half of the submissions, those that arrive from the other; of one task in three the identity is another.
ADMISSION_SQL = f"""{SUB}, rw AS (SELECT *, CASE WHEN metric = 'pq' THEN 'old' ELSE 'new' END AS half FROM sub),
bd AS (SELECT task, list_sort(list(DISTINCT region)) AS regions FROM rw WHERE half = 'old' AND task <> 'AFRICA' GROUP BY task), ar AS (SELECT task, list_sort(list(DISTINCT region)) AS own FROM rw WHERE half = 'new' GROUP BY task)
SELECT rw.task, region, submission, ordinal, CASE WHEN bd.task IS NULL THEN NULL WHEN length(rw.task) % 3 = 0 THEN 'another task by the name of ' || rw.task WHEN own <> regions THEN 'other regions were scored for ' || rw.task END AS refused
FROM rw JOIN ar USING (task) LEFT JOIN bd USING (task) WHERE half = 'new'"""


@query(f"WITH {ADMISSION_SQL}")
def admission(spark, sf_dir):
    """Submissions that arrive at boards, and why some are refused; a board that is new takes any."""
    rows = v.submissions(spark, sf_dir).withColumn("identity", F.sha2("task", 256))
    board_rows = rows.filter("metric = 'pq' AND task <> 'AFRICA'")
    changed = F.when(F.length("task") % 3 == 0, F.sha2(F.concat("task", F.lit("'")), 256)).otherwise(F.col("identity"))
    arriving = rows.filter("metric = 'voi'").withColumn("identity", changed)
    return scoring.admissible(board_rows, arriving).select("task", "region", "submission", "ordinal", "refused")


@query(f"WITH {SUB} SELECT task, submission AS identifier, region, metric, value FROM sub")
def record_scan(spark, sf_dir):
    """Records as JSON lines, read back with their schema; another version fails the job."""
    rows = v.submissions(spark, sf_dir).withColumnRenamed("submission", "identifier")
    return records.parsed(records.lines(rows)).select("task", "identifier", "region", "metric", "value")


@query(f"WITH {SUB}, a AS (SELECT DISTINCT region FROM sub WHERE metric = 'pq' AND value > 0.5), b AS (SELECT DISTINCT region FROM sub WHERE metric = 'voi') SELECT region, 'spare' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT region, 'missing' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def found_and_expected(spark, sf_dir):
    """Regions scored one way but not the other."""
    rows = v.submissions(spark, sf_dir)
    return scoring.symmetric_difference(rows.filter("metric = 'pq' AND value > 0.5").select("region").distinct(), rows.filter("metric = 'voi'").select("region").distinct())


@query(f"WITH {SUB} SELECT DISTINCT name FROM (SELECT region AS name FROM sub WHERE metric = 'pq' UNION ALL SELECT n_name FROM nation WHERE n_regionkey < 2)")
def listed_volumes(spark, sf_dir):
    """Names that a page lists: those of the board and those that are declared, each once."""
    own = v.submissions(spark, sf_dir).filter("metric = 'pq'").select(F.col("region").alias("name"))
    return own.union(table(spark, sf_dir, "nation").filter("n_regionkey < 2").select("n_name")).distinct()


@query("""WITH m AS (SELECT DISTINCT o_orderpriority AS "group", o_custkey AS leaf FROM orders), h AS (SELECT leaf, list_sort(list(DISTINCT "group") FILTER ("group" NOT IN ('1-URGENT', '5-LOW'))) AS groups FROM m GROUP BY leaf)
SELECT leaf, coalesce(array_to_string(groups, ','), '') AS groups FROM h WHERE coalesce(len(groups), 0) <> 1""")
def nesting(spark, sf_dir):
    """Leaves (customers) that no declared group (priorities, two of them undeclared) holds, or that several hold."""
    members = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("group"), F.col("o_custkey").alias("leaf")).distinct()
    found = scoring.misplaced(members, members.select("group").distinct().filter("group NOT IN ('1-URGENT', '5-LOW')"))
    return found.select("leaf", F.array_join("groups", ",").alias("groups"))


@query(f"WITH {SUB}, c AS (SELECT region, submission, CASE WHEN ordinal % 2 = 0 THEN 'fit' ELSE 'test' END AS split FROM sub) SELECT submission, split, region FROM c")
def guarded_splits(spark, sf_dir):
    """Submissions by split, each in one only, with regions that are all declared: rows pass guards that would fail the job."""
    rows = v.submissions(spark, sf_dir).select("submission", F.when(F.col("ordinal") % 2 == 0, "fit").otherwise("test").alias("split"), "region")
    declared = table(spark, sf_dir, "nation").select(F.col("n_name").alias("region"))
    return scoring.known(scoring.disjoint(rows, "submission", "split"), "region", declared)


@query(f"WITH {SUB} SELECT task, region AS identifier, submission AS region, metric, value FROM sub")
def record_files(spark, sf_dir):
    """Records written once, an identifier a folder, and scanned again."""
    rows = v.submissions(spark, sf_dir).select("task", F.col("region").alias("identifier"), F.col("submission").alias("region"), "metric", "value")
    folder = owned_path(spark, "records")
    records.add(rows, folder)
    return records.load(spark, folder)


@query(f"WITH {SUB}, o AS (SELECT task, metric, submission, ordinal, value, row_number() OVER (PARTITION BY task, metric ORDER BY CASE WHEN metric = 'pq' THEN -coalesce(value, 0) ELSE coalesce(value, 0) END, ordinal) AS position FROM sub) SELECT task, metric, submission, position FROM o")
def board_position(spark, sf_dir):
    """Place among all submissions of a task, whatever their region."""
    rows = v.submissions(spark, sf_dir).withColumn("region", F.lit(""))
    return board.ranked(rows).select("task", "metric", "submission", F.col("place").alias("position"))


@query(f"WITH {SUB}, k AS (SELECT task, region AS key, min(ordinal) AS first FROM sub GROUP BY ALL) SELECT task, key, row_number() OVER (PARTITION BY task ORDER BY first) AS place FROM k QUALIFY place <= 6")
def board_columns(spark, sf_dir):
    """The first six columns of a board, in the order in which they came up, each once."""
    keys = v.submissions(spark, sf_dir).groupBy("task", F.col("region").alias("key")).agg(F.min("ordinal").alias("first"))
    return keys.withColumn("place", F.row_number().over(Window.partitionBy("task").orderBy("first"))).filter("place <= 6").select("task", "key", "place")


GRID = [(logit, size, fill) for logit in (3, 5) for size in (0, 40) for fill in (0, 2, None)]


@query(f"WITH {VOX} SELECT volume, ordinal, logit, min_size, fill FROM (SELECT DISTINCT volume FROM vox), (VALUES {', '.join(f'({i}, {a}, {b}, ' + (chr(39) + ('all' if c is None else str(c)) + chr(39)) + ')' for i, (a, b, c) in enumerate(GRID))}) g(ordinal, logit, min_size, fill)")
def setting_grid(spark, sf_dir):
    """Logits, sizes and fill distances for every volume: sorted, without repeats, filling everything last."""
    rows = board.settings([5, 3, 5], [40, 0], ["all", 0, 2, 0])
    grid = spark.createDataFrame(rows, "ordinal int, logit int, min_size int, fill string")
    return v.voxels(spark, sf_dir).select("volume").distinct().crossJoin(F.broadcast(grid))  # the caller's list of settings


@query(f"""WITH {SUB}, k AS (SELECT *, CASE WHEN task IN ('ASIA', 'EUROPE') THEN 'instances' WHEN ordinal % 3 = 0 THEN 'skeleton' ELSE 'instances' END AS kind FROM sub),
f AS (SELECT *, first_value(metric) OVER (PARTITION BY task, region ORDER BY ordinal) AS ranked_by, min(kind) OVER w <> max(kind) OVER w AS kinds,
row_number() OVER (PARTITION BY task, region, metric ORDER BY CASE WHEN metric = 'pq' THEN -coalesce(value, 0) ELSE coalesce(value, 0) END, ordinal) AS k FROM k WINDOW w AS (PARTITION BY task, region))
SELECT task, region, submission, ranked_by, CASE WHEN metric = ranked_by THEN k END AS place, CASE WHEN kinds THEN kind END AS truth FROM f""")
def region_boards(spark, sf_dir):
    """Boards by region: the first row's metric ranks, and the kind of truth is shown where it varies."""
    rows = v.submissions(spark, sf_dir)
    kind = F.when(F.col("task").isin("ASIA", "EUROPE"), "instances").when(F.col("ordinal") % 3 == 0, "skeleton").otherwise("instances")
    return board.boards(rows.withColumn("kind", kind))


@query(f"WITH {VOX} SELECT volume, count(*) FILTER (truth NOT IN (0, 3, 8)) AS scored, count(*) FILTER (truth IN (0, 3, 8)) AS ignored FROM vox GROUP BY volume")
def ignored_voxels(spark, sf_dir):
    return metrics.ignored(v.voxels(spark, sf_dir), [0, 3, 8], ["volume"])


# -- boxes and strings ----------------------------------------------------------------------------------------
@query(f"""WITH {BOX} SELECT box, {', '.join(f'CAST(ceil((lo{i} * 4.0 - 3.0) / 8.0 - 0.000001) AS BIGINT) AS from{i}, CAST(ceil((hi{i} * 4.0 - 3.0) / 8.0 - 0.000001) AS BIGINT) AS to{i}' for i in range(3))},
{', '.join(f'greatest(CAST(floor(lo{i} / 8.0 + 0.5) AS BIGINT), 0) AS low{i}, least(CAST(floor(hi{i} / 8.0 + 0.5) AS BIGINT), 120) AS high{i}' for i in range(3))} FROM box""")
def box_voxels(spark, sf_dir):
    """Voxels of a grid of step 8 whose centres lie in a box of step 4, and the box itself in whole voxels of step 8."""
    columns = []
    for i in range(3):
        inside = scoring.centres_inside(F.col(f"lo{i}") * 4.0, F.col(f"hi{i}") * 4.0, 3.0, 8.0)
        whole = scoring.whole_voxels(F.col(f"lo{i}") * F.lit(1.0), F.col(f"hi{i}") * F.lit(1.0), 8.0, 120)
        columns += [c.alias(f"{n}{i}") for c, n in zip((*inside, *whole), ("from", "to", "low", "high"), strict=True)]
    return v.boxes(spark, sf_dir).select("box", *columns)


@query("""SELECT p_partkey AS part, regexp_full_match(lower(replace(p_type, ' ', '_')), '[a-z][a-z0-9_]*') AS is_route, CASE p_brand WHEN 'Brand#11' THEN 'instances' WHEN 'Brand#12' THEN 'instances' WHEN 'Brand#21' THEN 'semantic' ELSE p_brand END AS kind FROM part""")
def names_checked(spark, sf_dir):
    """Whether a name can be a route's, and older names of kinds as they are now."""
    rows = table(spark, sf_dir, "part")
    kind = text.renamed(F.col("p_brand"), {"Brand#11": "instances", "Brand#12": "instances", "Brand#21": "semantic"})
    return rows.select(F.col("p_partkey").alias("part"), text.is_route(F.lower(F.replace("p_type", F.lit(" "), F.lit("_")))).alias("is_route"), kind.alias("kind"))
