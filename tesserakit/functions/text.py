"""Strings of settings and regions, as boards and records show them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _add_ons(*parts: tuple[str, Column]) -> Column:
    """``name=value`` of the numbers that are not zero or null; a text is shown as it is."""
    shown = [F.when(F.coalesce(v.cast("string"), F.lit("0")).isin("0", "0.0"), None).otherwise(F.concat(F.lit(f"{n}="), v.cast("string"))) for n, v in parts]
    return F.array_compact(F.array(*shown))


def _called(name: Column | str, parts: Column) -> Column:
    return F.concat(F.lit(name) if isinstance(name, str) else name, F.lit("("), F.array_join(parts, ", "), F.lit(")"))


def describe_filter(min_size: Column, fill: Column) -> Column:
    """``identity(...)``: the add-ons that are on, or that none is."""
    parts = _add_ons(("min_size", min_size), ("fill_distance", fill))
    return F.when(F.size(parts) == 0, "identity(no filter)").otherwise(_called("identity", parts))


def describe_threshold(logit: Column, min_size: Column, fill: Column) -> Column:
    """``cc_threshold(logit=+3, thr=0.6457, ...)``: the logit with its sign, the threshold in four decimals, and what is on."""
    short = F.regexp_replace(F.regexp_replace(F.format_string("%+.6f", logit.cast("double")), "0+$", ""), r"\.$", "")
    own = F.array(F.concat(F.lit("logit="), short), F.format_string("thr=%.4f", 1 / (1 + F.exp(-0.2 * logit))))
    return _called("cc_threshold", F.concat(own, _add_ons(("min_size", min_size), ("fill_distance", fill))))


def describe_watershed(stride: Column, block: Column, min_size: Column, fill: Column) -> Column:
    """``mws(repulsive_stride=1, ...)``, or ``mws_blockwise(repulsive_stride=1, block=[64, 64, 64], ...)`` where there is a block."""
    own = F.concat(F.lit("repulsive_stride="), stride.cast("string"))
    sizes = F.concat(F.lit("block=["), F.array_join(F.transform(block, lambda n: n.cast("string")), ", "), F.lit("]"))
    whole = _called("mws", F.concat(F.array(own), _add_ons(("min_size", min_size), ("fill", fill))))
    return F.when(block.isNull(), whole).otherwise(_called("mws_blockwise", F.concat(F.array(own, sizes), _add_ons(("min_size", min_size)))))


def run_identifier(path: Column, step: Column, route: Column, label: Column | None = None, artifact: Column | None = None, postprocess: Column | None = None) -> Column:
    """``<last part of the run's path>.step<N>.<route>``; an older record's label as it is.

    Without a run the artifact's path, or else ``submission``, stands in; without a step there is none; without a route the
    post-processor's name, or else ``unknown``.
    """
    none = F.lit(None).cast("string")
    some = lambda c: none if c is None else F.when(c != "", c)
    run = F.coalesce(some(path), some(artifact), F.lit("submission"))
    stem = F.element_at(F.split(F.regexp_replace(run, "/+$", ""), "/"), -1)
    by = F.coalesce(some(route), some(postprocess), F.lit("unknown"))
    return F.coalesce(some(label), F.concat_ws(".", stem, F.concat(F.lit("step"), step.cast("string")), by))


def region_key(volumes: Column) -> Column:
    """Of an array of (name, shape, whole): ``name 4x5x6`` by name, with ``(sub-region)`` where it is not whole, ``; `` between.

    A shape that is not known is ``?``; no volumes are ``unspecified``.
    """
    extent = lambda v: F.coalesce(F.array_join(F.transform(v["shape"], lambda n: n.cast("string")), "x"), F.lit("?"))
    part = lambda v: F.concat(v["name"], F.lit(" "), extent(v), F.when(F.coalesce(v["whole"], F.lit(False)), "").otherwise(" (sub-region)"))
    return F.when(F.coalesce(F.size(volumes), F.lit(0)) <= 0, "unspecified").otherwise(F.array_join(F.transform(F.array_sort(volumes), part), "; "))


def task_identity(volumes: Column, metric: Column, key: Column, settings: Column) -> Column:
    """What a task's rows compete on, as one JSON text: its volumes by name with their truths, the metric, its key and its settings.

    ``volumes``: an array of structs that begin with the name; nulls are written as such, so that a field that is missing
    and one that is null are the same task.
    """
    fields = F.struct(F.array_sort(volumes).alias("volumes"), metric.alias("metric"), key.alias("key"), settings.alias("settings"))
    return F.to_json(fields, {"ignoreNullFields": "false"})


def is_route(name: Column) -> Column:
    """Whether a name can be a route's: lower-case letters, digits and underscores, a letter first."""
    return name.rlike(r"^[a-z][a-z0-9_]*\z")


def renamed(name: Column, now: dict[str, str]) -> Column:
    """Older names as they are now; others stay."""
    out = name
    for old, new in now.items():
        out = F.when(name == old, new).otherwise(out)
    return out
