"""Line dedup with a log-template tree, in DataFrame operations only.

The tree has fixed depth: token count, then the leading tokens, after fields
with digits became ``<*>``.  A leaf has any number of templates.  The first has
the most common token at each position; a line belongs to it when enough
positions agree, so variable fields generalise.  Each other line has its own
tokens where enough lines of the leaf share the token at that place, and
``<*>`` elsewhere; enough of them must be its own.  A template that recurs in
enough documents is boilerplate: its first line stays, all others are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrid.llm.common import row_key
from labelgrid.plans.materialize import materialize, scratch

#: Leading tokens that lead to a leaf; all of a shorter line, where those take part.
LEADING = 3
#: Share of positions that must agree with the template.
AGREE = 0.7
#: Documents in which a template must occur, and lines that must share a token for it to be kept in a template.
MIN_DOCS = 5

#: A template's place in the tree.
LEAF = ["leaf", "n"]
RK, DROP, LINES = "_labelgrid_row", "_labelgrid_drop", "_labelgrid_lines"


def with_masked(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``m``: the text in lower case, single blanks, none at the ends of lines, ``<*>`` for tokens with a digit.

    Each pattern runs only over texts that have something for it, and is possessive, so linear in long tokens.
    Every step is a projection of its own, so no step is worked out twice.
    """
    out = docs.withColumn("m", F.lower(text))
    for has, what, to in (("[\t\r]|  ", "[ \t\r]++", " "), ("^ | $|\n | \n", "(?m)^ | $", ""), ("[0-9]", "(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+", "<*>")):
        out = out.withColumn("m", F.when(F.col("m").rlike(has), F.regexp_replace("m", what, to)).otherwise(F.col("m")))
    return out


def _lines(docs: DataFrame, shortest: int) -> DataFrame:
    """``rk, doc, pos, m, n, leaf`` for each line of at least ``shortest`` tokens (1 or more).

    Texts are masked before they are split: an expression under a filter on lines would be worked out twice.
    """
    lines = with_masked(docs, "body").select("rk", "doc", F.posexplode(F.split("m", "\n")).alias("pos", "m"))
    lines = lines.where(F.col("m").like("_%" + " %" * (shortest - 1))).withColumn("n", F.length("m") - F.length(F.replace("m", F.lit(" "))) + 1)
    return lines.withColumn("leaf", F.xxhash64(F.substring_index("m", " ", LEADING)))


def _templates(kinds: DataFrame, min_docs: int) -> DataFrame:
    """``leaf, n, m, template`` for the distinct lines (``kinds``, with their number) that belong to one; "" is a leaf's first.

    A leaf's templates are small beside its lines: they are written first, so the joins know their size.
    """
    tokens = lambda k: k.select(*LEAF, "m", "count", F.posexplode(F.split("m", " ")).alias("i", "t"))
    votes = tokens(kinds).groupBy(*LEAF, "i", "t").agg(F.sum("count").alias("c"))
    best = votes.groupBy(*LEAF, "i").agg(F.max(F.struct("c", "t")).alias("b"))
    first = best.groupBy(*LEAF).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.col("b.t").alias("t")))), lambda x: x["t"]).alias("first"))
    agree = F.size(F.filter(F.zip_with(F.split("m", " "), "first", lambda a, b: a == b), lambda x: x))
    judged = materialize(kinds.join(materialize(first, "line-templates"), LEAF).select(*LEAF, "m", "count", (agree >= F.col("n") * AGREE).alias("alike")), "line-kinds")
    rest = tokens(judged.where("NOT alike"))
    common = rest.groupBy(*LEAF, "i", "t").agg(F.sum("count").alias("c")).where(F.col("c") >= min_docs).select(*LEAF, "i", "t", F.col("t").alias("kept"))
    own = rest.join(common, [*LEAF, "i", "t"], "left").groupBy(*LEAF, "m").agg(F.count("kept").alias("k"), F.array_sort(F.collect_list(F.struct("i", F.coalesce("kept", F.lit("<*>")).alias("t")))).alias("p"))
    own = own.where(F.col("k") >= F.col("n") * AGREE).select(*LEAF, "m", F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("template"))
    return materialize(judged.where("alike").select(*LEAF, "m", F.lit("").alias("template")).unionByName(own), "line-members")


def recurring_lines(df: DataFrame, id_col: str, text_col: str, min_docs: int = MIN_DOCS, shortest: int = LEADING) -> DataFrame:
    """``rk, drop``: the positions of lines to drop, ascending, for each document that has any."""
    with scratch() as kept:  # the lines go, the positions stay
        docs = df.select(row_key(id_col, text_col).alias("rk"), F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
        lines = materialize(_lines(docs, shortest), "lines")
        # Which leaves occur in enough documents: keys only, combined before the shuffle.
        often = lines.groupBy(*LEAF, "rk").agg(F.lit(1).alias("one")).groupBy(*LEAF).count()
        often = materialize(often.where(F.col("count") >= min_docs).select(*LEAF), "line-leaves")
        hot = materialize(lines.join(often, LEAF, "left_semi"), "hot-lines")
        # Copies of a line count once with their number, so a hot line is one row per task.
        member = hot.join(_templates(hot.groupBy(*LEAF, "m").count(), min_docs), [*LEAF, "m"]).select(*LEAF, "template", "rk", "doc", "pos")
        # One row per template: the documents it is in, and its first line.
        group = [*LEAF, "template"]
        spread = member.groupBy(*group, "rk").agg(F.min(F.struct("doc", "rk", "pos")).alias("f")).groupBy(*group).agg(F.count("*").alias("docs"), F.min("f").alias("f"))
        spread = materialize(spread.where(F.col("docs") >= min_docs).select(*group, F.col("f.rk").alias("first_rk"), F.col("f.pos").alias("first_pos")), "line-spread")
        drop = member.join(spread, group).where((F.col("rk") != F.col("first_rk")) | (F.col("pos") != F.col("first_pos")))
        out = materialize(drop.groupBy("rk").agg(F.sort_array(F.collect_set("pos")).alias("drop")), "line-drops")
        kept.append(out)
    return out


def drop_recurring_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, shortest: int = LEADING) -> DataFrame:
    """``df`` with recurring lines gone from ``text_col``; two columns follow: ``lines_total``, ``lines_dropped`` (int).

    Lines of under ``shortest`` tokens and empty ones stay.  Lines end at ``\\n``.  The first line of a template is that of the smallest (id, row); NULL ids come first.  Rows
    equal in id and text are one document and get one result.  A NULL text stays NULL with 0 lines; an empty text has
    one line.  A text of any length is one row; time is linear in its lines.  All other columns (but two of those names)
    and an empty frame pass unchanged.
    """
    drops = recurring_lines(df, id_col, text_col, min_docs, shortest).withColumnsRenamed({"rk": RK, "drop": DROP})
    # Texts travel as lines, which are put together again: below a join they are split once.
    split = df.withColumn(RK, row_key(id_col, text_col)).withColumn(LINES, F.split(text_col, "\n")).drop(text_col)
    joined = split.join(drops, RK, "left")
    count = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    start = lambda j: F.when(j == 0, 0).otherwise(F.get(DROP, j - 1) + 1)
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(DROP)), lambda j: F.slice(LINES, start(j) + 1, F.coalesce(F.get(DROP, j), F.size(LINES)) - start(j))))
    text = F.array_join(F.when(F.col(DROP).isNull(), F.col(LINES)).otherwise(kept), "\n")
    rest = [text.alias(c) if c == text_col else F.col(c) for c in df.columns if c not in ("lines_total", "lines_dropped")]
    return joined.select(*rest, count(LINES).alias("lines_total"), count(DROP).alias("lines_dropped"))
