"""Line dedup: three-line windows that stand somewhere before lose their lines.

Every three consecutive lines of a text are hashed; of the places of a window, over all documents, the first in the
order of (doc_id, line) stays, and in all later places its three lines are marked. Overlapping marks are merged and
the lines outside them are joined again. DataFrame functions only.

Defined results: lines end at line feeds. A text of fewer than three lines has no window and stays as it is, also an
empty one; a null text stays null with 0 lines. Windows without any visible character don't count. A null doc_id comes
first. Rows that are equal in doc_id and text are one place, so all of them keep the same lines; rows with one doc_id
and different texts are ordered by the texts' hashes. Other columns pass
through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.llm.common import materialise, unused

#: Lines of a window.
WINDOW = 3

# The lines are bound to a lambda's variable, which holds them once for each text. Two hashes with different seeds make
# 128 bits, so that windows of even 10 ** 15 lines don't meet by chance.
_WINDOWS = f"""element_at(transform(array(transform(split(text, '\\n', -1), l -> struct(xxhash64(l) AS a, xxhash64(20, l) AS b, l rlike '[^\\\\s]' AS seen))),
    h -> if(size(h) < {WINDOW}, array(), transform(sequence(0, size(h) - {WINDOW}), i -> struct(i AS line,
        xxhash64({", ".join(f"h[i + {j}].a" for j in range(WINDOW))}) AS window_a, xxhash64({", ".join(f"h[i + {j}].b" for j in range(WINDOW))}) AS window_b,
        {" OR ".join(f"h[i + {j}].seen" for j in range(WINDOW))} AS seen)))), 1)"""

# Marks sorted by line: the lines kept lie before the first mark, from a mark's end to the next mark, and after the last.
_KEPT = f"""element_at(transform(array(struct(split(text, '\\n', -1) AS l, {{marks}} AS m)), x -> if(x.m IS NULL, x.l, flatten(transform(sequence(0, size(x.m)), i ->
    slice(x.l, 1 + if(i = 0, 0, x.m[i - 1] + {WINDOW}), greatest(0, if(i = size(x.m), size(x.l), x.m[if(i = size(x.m), 0, i)]) - if(i = 0, 0, x.m[i - 1] + {WINDOW}))))))), 1)"""


def _text_hash() -> Column:
    return F.xxhash64("text")


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line, window_a, window_b of each window."""
    rows = docs.filter("text IS NOT NULL").select("doc_id", _text_hash().alias("text_hash"), F.explode(F.expr(_WINDOWS)).alias("w"))
    return rows.filter("w.seen").select("doc_id", "text_hash", "w.line", "w.window_a", "w.window_b")


def marks(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and the sorted first lines of the windows that stand somewhere before."""
    found = windows(docs)
    place = F.struct("doc_id", "text_hash", "line")
    # a window that a third of all rows share is reduced to one row in each task before it is shuffled
    repeated = found.groupBy("window_a", "window_b").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select("window_a", "window_b", "first")
    # written first, so that the join shuffles both sides for itself alone and a skewed window can be split
    repeated = materialise(repeated)
    later = found.join(repeated, ["window_a", "window_b"]).filter(place > F.col("first"))
    return later.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line")).alias("marks"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with text reduced to the lines kept, and n_lines and n_removed (instead of columns with these names)."""
    own_id, own_hash, own_marks, own_kept = unused(docs, "own_id", "own_hash", "own_marks", "own_kept")
    found = marks(docs).select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash), F.col("marks").alias(own_marks))
    rows = docs.join(found, docs.doc_id.eqNullSafe(F.col(own_id)) & (_text_hash() == F.col(own_hash)), "left").withColumn(own_kept, F.expr(_KEPT.format(marks=own_marks)))
    there = F.col("text").isNotNull()
    n = F.when(there, F.size(F.split("text", "\n", -1))).otherwise(0)
    left = F.when(there, F.size(own_kept)).otherwise(0)
    text = F.when(F.col(own_marks).isNull(), F.col("text")).otherwise(F.array_join(own_kept, "\n"))
    same = [text.alias(c) if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return rows.select(*same, n.cast("long").alias("n_lines"), (n - left).cast("long").alias("n_removed"))


SQL = f"""
WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
     windows AS (SELECT doc_id, i AS line, l[i + 1] || chr(10) || l[i + 2] || chr(10) || l[i + 3] AS w
                 FROM (SELECT doc_id, l, unnest(range(0, len(l) - {WINDOW - 1})) AS i FROM lines)),
     ranked AS (SELECT doc_id, line, row_number() OVER (PARTITION BY w ORDER BY doc_id, line) AS r FROM windows WHERE regexp_matches(w, '[^\\s]')),
     covered AS (SELECT DISTINCT doc_id, unnest(range(line, line + {WINDOW})) AS line FROM ranked WHERE r > 1),
     kept AS (SELECT s.doc_id, string_agg(s.t, chr(10) ORDER BY s.line) AS text, count(*) AS n
              FROM (SELECT doc_id, unnest(l) AS t, unnest(range(0, len(l))) AS line FROM lines) s
              ANTI JOIN covered c ON s.doc_id = c.doc_id AND s.line = c.line GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
       CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) - coalesce(k.n, 0) END AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
