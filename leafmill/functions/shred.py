"""The shred() column: HTML text to an array of nodes, one Arrow batch at a time."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from ..schemas import NODES
from . import markup
from .markup import flatten, tree


def _nodes(pages: pa.Array) -> pa.Array:
    """Builds the nested Arrow array from flat lists, without per-node dictionaries."""
    flat = [[] for _ in range(13)]
    page_ends, attr_ends, class_ends, path_ends = [0], [0], [0], [0]
    keys, values, classes, paths = [], [], [], []
    total = 0
    for html in pages.to_pylist():
        if html is None:
            page_ends.append(None)
            continue
        for row in flatten(tree(html)):
            for column, value in zip(flat, row):
                column.append(value)
            keys.extend(row[5])
            values.extend(row[5].values())
            attr_ends.append(len(keys))
            classes.extend(row[6])
            class_ends.append(len(classes))
            paths.extend(row[11])
            path_ends.append(len(paths))
            total += 1
        page_ends.append(total)
    offsets, last = [0], 0
    for end in page_ends[1:]:
        last = end if end is not None else last
        offsets.append(last)
    missing = pa.array([end is None for end in page_ends[1:]], pa.bool_())
    ints = {i: pa.array(flat[i], pa.int32()) for i in (0, 1, 2, 3, 7, 8, 9, 10)}
    attrs = pa.MapArray.from_arrays(
        pa.array(attr_ends, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string())
    )
    class_lists = pa.ListArray.from_arrays(
        pa.array(class_ends, pa.int32()), pa.array(classes, pa.string())
    )
    path_lists = pa.ListArray.from_arrays(
        pa.array(path_ends, pa.int32()), pa.array(paths, pa.int32())
    )
    node = pa.StructArray.from_arrays(
        [
            ints[0], ints[1], ints[2], ints[3], pa.array(flat[4], pa.string()), attrs, class_lists,
            ints[7], ints[8], ints[9], ints[10], path_lists, pa.array(flat[12], pa.string()),
        ],
        names=[
            "pre", "n_desc", "parent", "prev", "tag", "attrs", "classes",
            "sib", "n_sib", "sib_of_type", "n_sib_of_type", "path", "text",
        ],
    )
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), node, mask=missing)


# The helper travels with the job, so executors need no copy of this package.
for module in (fixed, markup, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(module)


def shred(html: Column | str) -> Column:
    """HTML text to its node array (schemas.NODES); narrow, no shuffle.

    Declared non-deterministic so that the optimizer keeps one evaluation per page instead of
    repeating it in every filter and projection derived from the nodes.
    """
    once = F.arrow_udf(_nodes, NODES).asNondeterministic()
    return once(html if isinstance(html, Column) else F.col(html))
