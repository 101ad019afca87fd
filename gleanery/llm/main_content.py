"""Main body of web pages by a site style tree.

Pages of one host are merged into a tree. Its element nodes are the containers
by their path of tags and classes; the style nodes of an element are the
different sequences of elements that pages put directly inside it; its leaves
are the lines. The importance of a line is one minus the entropy of its
signature (the visible text with names and numbers masked) over the host's
pages, ``1 - log(k) / log(m)`` for a signature on k of m pages: 1 for text of a
single page, 0 for text of every page. The same measure over the pages of all
hosts judges signatures on hosts with few pages; a line takes the lower of both.
The importance of an element by itself is the entropy of its styles over the
pages, base the number of pages: 0 when all pages build it alike, 1 when each
builds its own. Its composite importance is found bottom-up:
``(1 - g ** l) * own + g ** l * mean of what is inside it`` for l styles, as a
choice of many styles says more than one of few.

Branches of low composite importance are pruned from each page, line by line of
their own. Of what is left the branch of the page's own heading is kept, with
further branches of important prose; branches that open with an unimportant
heading (comments, further reading) and branches of links are removed, as are unimportant lines inside the kept branches. A page
whose kept branch consists mainly of linked lines only lists other pieces and
has no main body.

Counts are map-side combined per (host, signature) and per (host, element,
style); nothing is gathered but the lines of one page, and the tree is folded
level by level with joins. Defined results: null, empty or unparsable html gives
no line; pages without host are judged with the others without host; redelivered
pages count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.html_lines import page_view
from gleanery.operators.joins import join_small
from gleanery.session import cut_lineage

#: Content nodes up to this importance are boilerplate.
LOW_CONTENT = 0.6
#: Branches up to this composite importance are pruned.
LOW_BRANCH = 0.4
#: Signatures on one page in so many, or more often, are hot keys.
HOT_SHARE = 1024
#: Weight of what is inside an element against its own styles, per style.
INSIDE = 0.9
#: A line whose text is linked from this share on is a link, if it does not
#: end as a sentence does.
LINK_SHARE = 0.9

_WORD = re.compile(r"[^\W\d_][\w'’-]*")
_CAPITAL = re.compile(r"\b[^\W\d_a-zß-öø-ÿ][\w'’-]*")
_NUMBER = re.compile(r"\d+")
_SENTENCE_END = re.compile(r"[.!?…][\"'”’»)\]]*$")


def is_shouted(text: str) -> bool:
    """At least two words, all letters upper case."""
    return text.upper() == text and text.lower() != text and len(_WORD.findall(text)) >= 2


def signature(text: str) -> str:
    """Content feature of a line: names and numbers masked. A shouted line
    keeps its words, as nothing tells names from the rest."""
    if is_shouted(text):
        return _NUMBER.sub("0", text.lower())
    return _NUMBER.sub("0", _CAPITAL.sub("#", text))


_LINES = T.StructType(
    [
        T.StructField("raw_path", T.StringType()),
        T.StructField("line_no", T.ArrayType(T.IntegerType())),
        T.StructField("branch", T.ArrayType(T.IntegerType())),
        T.StructField("sig", T.ArrayType(T.LongType())),
        T.StructField("node", T.ArrayType(T.LongType())),
        T.StructField("n_words", T.ArrayType(T.IntegerType())),
        T.StructField("flags", T.ArrayType(T.IntegerType())),
        T.StructField("path", T.ArrayType(T.LongType())),
        T.StructField("above", T.ArrayType(T.LongType())),
        T.StructField("depth", T.ArrayType(T.IntegerType())),
        T.StructField("style", T.ArrayType(T.LongType())),
    ]
)
#: Bits of flags.
FIRST, HEADING, LINK, TITLE, SHOUTED = 1, 2, 4, 8, 16


def _plain(text: str) -> str:
    return " ".join(_WORD.findall(text.lower()))


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for path, page in zip(pdf["raw_path"], pdf["html"]):
            title, rows, branches = page_view(page)
            title = _plain(title)
            seen: set[str] = set()
            sigs, flags = [], []
            for r in rows:
                sig, plain = signature(r.text), _plain(r.text)
                is_link = r.link_chars >= LINK_SHARE * len(r.text) and not _SENTENCE_END.search(r.text)
                flag = FIRST * (sig not in seen) + HEADING * r.heading + LINK * is_link
                if not is_link and len(plain) >= 8 and title.startswith(plain):
                    flag += TITLE
                flag += SHOUTED * is_shouted(r.text)
                seen.add(sig)
                sigs.append(sig)
                flags.append(flag)
            names = [_hash(b.path) for b in branches]
            # a page uses each style of an element once, however often it repeats it
            used = dict.fromkeys((names[i], names[b.parent], b.depth, _hash(" ".join(b.style))) for i, b in enumerate(branches))
            out.append(
                (
                    path, [r.no for r in rows], [r.branch for r in rows], [_hash(x) for x in sigs],
                    [names[r.branch] for r in rows], [len(_WORD.findall(r.text)) for r in rows], flags,
                    *([u[i] for u in used] for i in range(4)),
                )
            )
        yield pd.DataFrame(out, columns=_LINES.names)


def page_nodes(web_pages: DataFrame, web_raw: DataFrame) -> DataFrame:
    """One row per fetched page: doc_id, host, its lines and the styles of its
    elements as structs."""
    parsed = (
        web_raw.select("raw_path", "html")
        .where(F.col("html").isNotNull() & F.col("raw_path").isNotNull())
        .mapInPandas(_parse, _LINES)
        .select(
            "raw_path",
            F.arrays_zip("line_no", "branch", "sig", "node", "n_words", "flags").alias("nodes"),
            F.arrays_zip("path", "above", "depth", "style").alias("elements"),
        )
    )
    pages = (
        web_pages.select(
            "doc_id",
            F.coalesce(F.lower(F.btrim("source_id", F.lit(" \t\n\r\xa0"))), F.lit("")).alias("host"),
            "raw_path",
        )
        .where(F.col("doc_id").isNotNull() & F.col("raw_path").isNotNull())
        .distinct()
    )
    return pages.join(parsed, "raw_path").select("doc_id", "host", "nodes", "elements")


def _importance(k: str, m: str):
    return F.when(F.col(m) > 1, 1 - F.ln(k) / F.ln(m)).otherwise(F.lit(1.0))


def content_importance(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """host, sig, importance, is_hot of the signatures found on more than one page;
    hot are those on ``1 / HOT_SHARE`` of all pages or more."""
    per_host = lines.where(F.col("is_first")).groupBy("host", "sig").agg(F.count(F.lit(1)).alias("k"))
    per_all = per_host.groupBy("sig").agg(F.sum("k").alias("k_all")).where(F.col("k_all") > 1)
    hosts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("m"))
    total = pages.agg(F.count(F.lit(1)).alias("n"))
    return (
        join_small(per_host.join(per_all, "sig"), hosts, ["host"], F.col("sig"))
        .withColumn("m_all", total.scalar())
        .select(
            "host", "sig",
            F.least(_importance("k", "m"), _importance("k_all", "m_all")).alias("importance"),
            (F.col("k") * HOT_SHARE >= F.col("m_all")).alias("is_hot"),
        )
    )


def judged_lines(lines: DataFrame, content: DataFrame) -> DataFrame:
    """Lines with their importance, 1 where a signature is found on no other page.

    A page has few lines, so the hot signatures are at most ``HOT_SHARE`` times
    the lines of a page: they are sent to the lines. What they decide is spread
    over the join of the rest, so no key of it is hot."""
    content = cut_lineage(content)
    hot = content.where("is_hot").select("host", "sig", F.col("importance").alias("of_hot"))
    rest = content.where("NOT is_hot").select("host", F.col("sig").alias("key"), F.lit(False).alias("done"), F.col("importance").alias("of_rest"))
    marked = lines.join(F.broadcast(hot), ["host", "sig"], "left").withColumn("done", F.col("of_hot").isNotNull()).withColumn(
        "key", F.when(F.col("done"), F.xxhash64("doc_id", "line_no")).otherwise(F.col("sig"))
    )
    return marked.join(rest, ["host", "key", "done"], "left").withColumn(
        "importance", F.coalesce("of_hot", "of_rest", F.lit(1.0))
    ).drop("key", "done", "of_hot", "of_rest")


def branch_importance(elements: DataFrame, judged: DataFrame) -> DataFrame:
    """host, node, composite of every element of the hosts' trees.

    ``elements`` has a row per page and style it uses (host, path, above, depth,
    style), ``judged`` the lines with their node and importance."""
    uses = elements.groupBy("host", "path", "above", "depth", "style").agg(F.count(F.lit(1)).alias("k"))
    own = uses.groupBy("host", "path", "above", "depth").agg(
        F.sum("k").alias("m"), F.count(F.lit(1)).alias("l"), F.sum(F.col("k") * F.ln("k")).alias("klnk")
    ).withColumn("own", F.when(F.col("m") > 1, 1 - F.col("klnk") / (F.col("m") * F.ln("m"))).otherwise(1.0))
    leaves = judged.groupBy("host", F.col("node").alias("path")).agg(F.sum("importance").alias("leaf_sum"), F.count(F.lit(1)).alias("n_leaves"))
    tree = cut_lineage(own.join(leaves, ["host", "path"], "left").fillna(0, ["leaf_sum", "n_leaves"]))
    deepest = tree.agg(F.max("depth")).first()[0]
    below, levels = None, None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        level = tree.where(F.col("depth") == depth)
        if below is not None:
            inside = below.groupBy("host", F.col("above").alias("path")).agg(
                F.sum(F.col("composite") * F.col("m")).alias("inner_sum"), F.sum("m").alias("n_inner")
            )
            level = level.join(inside, ["host", "path"], "left").fillna(0, ["inner_sum", "n_inner"])
        else:
            level = level.withColumn("inner_sum", F.lit(0.0)).withColumn("n_inner", F.lit(0))
        size = F.col("n_leaves") + F.col("n_inner")
        mean = F.when(size > 0, (F.col("leaf_sum") + F.col("inner_sum")) / size).otherwise(F.col("own"))
        weight = F.pow(F.lit(INSIDE), F.col("l"))
        below = cut_lineage(level.select(
            "host", "path", "above", "m", ((1 - weight) * F.col("own") + weight * mean).alias("composite")
        ))
        levels = below if levels is None else levels.unionByName(below)
    if levels is None:
        levels = tree.select("host", "path", "above", "m", F.lit(1.0).alias("composite"))
    return levels.select("host", F.col("path").alias("node"), "composite")


_KEPT = T.StructType(
    [T.StructField("doc_id", T.StringType()), T.StructField("line_no", T.IntegerType())]
)


def keep_lines(nodes) -> list[int]:
    """Line numbers of the main body of one page.

    ``nodes`` are (line_no, branch, n_words, flags, importance, composite
    importance of the branch)."""
    nodes = sorted(nodes, key=lambda x: x[0])
    branches: dict[int, list] = {}
    for x in nodes:
        branches.setdefault(x[1], []).append(x)

    def low(x) -> bool:
        if x[3] & TITLE:
            return False
        if x[4] <= LOW_CONTENT or x[5] <= LOW_BRANCH:
            return True
        return bool(x[3] & SHOUTED and not x[3] & HEADING)

    def prose(xs) -> list:
        return [x for x in xs if not low(x) and not x[3] & (LINK | HEADING | TITLE)]

    def words(xs) -> int:
        return sum(x[2] for x in prose(xs))

    titled = [b for b, xs in branches.items() if any(x[3] & TITLE for x in xs)]
    open_ok = [b for b, xs in branches.items() if not low(xs[0])]
    if titled:
        main = max(titled, key=lambda b: (words(branches[b]), -b))
    elif open_ok:
        main = max(open_ok, key=lambda b: (words(branches[b]), -b))
    else:
        return []
    kept = [main] + [
        b for b in open_ok if b != main and b > main and words(branches[b])
        and len(prose(branches[b])) > sum(bool(x[3] & LINK) for x in branches[b])
    ]
    lines = [x for b in kept for x in branches[b]]
    links = sum(bool(x[3] & LINK) and x[2] >= 3 for x in lines)
    if not prose(lines) or links > len(prose(lines)):
        return []
    return sorted(x[0] for x in lines if not low(x) and not x[3] & LINK)


def _decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        docs, nos = [], []
        for doc, nodes in zip(pdf["doc_id"], pdf["nodes"]):
            got = keep_lines(
                [
                    (x["line_no"], x["branch"], x["n_words"], x["flags"], x["importance"], x["composite"])
                    for x in nodes
                ]
            )
            docs += [doc] * len(got)
            nos += got
        yield pd.DataFrame({"doc_id": docs, "line_no": pd.Series(nos, dtype="int32")})


def main_lines(web_pages: DataFrame, web_raw: DataFrame) -> DataFrame:
    """doc_id, line_no of the lines that carry each page's main body."""
    pages = cut_lineage(page_nodes(web_pages, web_raw))
    lines = pages.select("doc_id", "host", F.inline("nodes")).withColumn(
        "is_first", F.col("flags").bitwiseAND(FIRST) > 0
    )
    content = content_importance(lines, pages.select("doc_id", "host"))
    judged = judged_lines(lines, content)
    tree = branch_importance(pages.select("host", F.inline("elements")), judged)
    return (
        join_small(judged, tree, ["host", "node"], F.struct("doc_id", "line_no"))
        .groupBy("doc_id")
        .agg(
            F.collect_list(
                F.struct("line_no", "branch", "n_words", "flags", "importance", "composite")
            ).alias("nodes")
        )
        .mapInPandas(_decide, _KEPT)
    )
