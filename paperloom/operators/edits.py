"""Edit logs folded into trees of nodes, and outlines of paragraphs.

nodes: doc_id, node_id, path (array of ordinals; its order is document order),
type, text, bold, size, align, list, alt, src. edits: doc_id, seq, op, node_id,
value. A log becomes a summary by node: what any run of edits does to a
paragraph is one small struct, and such structs compose. So a log is folded in
runs by seq, and the runs are folded again, however many edits a node has.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.sources.work import stored

#: Operations whose last value holds.
SET = ("text", "align", "size", "list", "src", "alt")
#: Path elements from here on are siblings that were inserted behind what the elements before them name.
BEHIND = 1 << 40
#: Edits of a node that are folded at once, by seq.
RUN = 4096
#: What a run of edits does to the children of a paragraph: whether it left none (emptied) before the last time they got text;
#: toggles (0, 1, or 2 for any even number) and size before the first text since; whether text was set (told), the last one; odd toggles and size since.
SUMMARY = "struct<emptied:boolean,flips:int,size:double,told:boolean,text:string,odd:int,later:double>"


def block_path(path: str | Column = "path") -> Column:
    """The part of a path that names the top-level block."""
    return F.filter(path, lambda x, i: (i == 0) | (x >= BEHIND))


def inner_path(path: str | Column = "path") -> Column:
    """The ordinals below the top-level block."""
    return F.filter(path, lambda x, i: (i > 0) & (x < BEHIND))


def fold(edits: DataFrame, by: list[str]) -> DataFrame:
    """What the log leaves of each node: the last value of each operation, whether bold was toggled an odd number of times, deleted."""
    last = [F.max_by(F.when(F.col("op") == op, F.col("value")), F.when(F.col("op") == op, F.col("seq"))).alias(op) for op in SET]
    toggles = (F.count_if(F.col("op") == "bold") % 2 == 1).alias("bold")
    return edits.groupBy(*by).agg(*last, toggles, F.coalesce(F.bool_or(F.col("op") == "delete"), F.lit(False)).alias("deleted"))


def _summary(emptied=False, flips=0, size=None, told=False, text=None, odd=0, later=None) -> Column:
    lit = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
    return F.struct(
        lit(emptied, "boolean").alias("emptied"), lit(flips, "int").alias("flips"), lit(size, "double").alias("size"), lit(told, "boolean").alias("told"),
        lit(text, "string").alias("text"), lit(odd, "int").alias("odd"), lit(later, "double").alias("later"),
    )


def summary_of(op: Column, value: Column) -> Column:
    """The summary of one edit; operations that don't reach children do nothing."""
    empty = F.coalesce(value, F.lit("")) == ""
    return (
        F.when((op == "text") & empty, _summary(emptied=True))
        .when(op == "text", _summary(told=True, text=value))
        .when(op == "bold", _summary(flips=1))
        .when(op == "size", _summary(size=value.try_cast("double")))
        .otherwise(_summary())
    )


def then(a: Column, b: Column) -> Column:
    """The summary of a's edits followed by b's."""
    flips = a["flips"] + b["flips"]
    return (
        F.when(b["emptied"], b)
        .when(a["emptied"] & ~a["told"], F.when(b["told"], _summary(True, 0, None, True, b["text"], b["odd"], b["later"])).otherwise(a))
        .when(a["told"], _summary(a["emptied"], a["flips"], a["size"], True, F.coalesce(b["text"], a["text"]), (a["odd"] + b["flips"] + b["odd"]) % 2, F.coalesce(b["later"], b["size"], a["later"])))
        .otherwise(_summary(False, F.when(flips == 0, 0).when(flips % 2 == 1, 1).otherwise(2), F.coalesce(b["size"], a["size"]), b["told"], b["text"], b["odd"], b["later"]))
    )


def summed(summaries: Column) -> Column:
    """One summary of an array of them, in order."""
    return F.aggregate(summaries, _summary(), then)


def folded(log: DataFrame, by: list[str]) -> DataFrame:
    """(by, did, align, list, src, alt): the summary and the last set values of a log (by, seq, op, value).

    An edit that comes repeatedly counts once; different ones of one seq go by
    op and value. No task holds more than RUN different seqs of a node at once.
    """
    last = lambda op: F.max(F.when(F.col("op") == op, F.struct("seq", "value"))).alias(op)
    edit = F.struct("seq", "op", "value")
    runs = log.groupBy(*by, F.floor(F.col("seq") / RUN).alias("run")).agg(F.array_sort(F.collect_list(F.when(F.col("op").isin("text", "bold", "size"), edit))).alias("e"), *[last(k) for k in ("align", "list", "src", "alt")])
    once = F.filter("e", lambda x, i: (i == 0) | ~x.eqNullSafe(F.get("e", i - 1)))
    runs = runs.withColumn("did", summed(F.transform(once, lambda x: summary_of(x["op"], x["value"]))))
    whole = runs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("run", "did"))).alias("runs"), *[F.max(k)["value"].alias(k) for k in ("align", "list", "src", "alt")])
    return whole.select(*by, summed(F.transform("runs", lambda r: r["did"])).alias("did"), "align", "list", "src", "alt")


def restructured(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, node_id, root, place, born): inserted paragraphs that are left, place-th behind root, and deleted ones of the tree (place 0).

    Insertions and deletions of a document are replayed by seq in one task,
    which holds their ids: a paragraph that is gone or not at the top is no
    anchor, and an id that is taken makes no paragraph. Without a value the id
    is p and the next free number; numbers aren't used again.
    """
    tops = nodes.where((F.col("type") == "paragraph") & (F.size(inner_path()) == 0)).select("doc_id", "node_id", F.lit(True).alias("known"))
    moves = edits.where(F.col("op").isin("insert", "delete")).select("doc_id", "seq", "op", "node_id", "value")
    moves = moves.join(tops, ["doc_id", "node_id"], "left").join(nodes.select("doc_id", F.col("node_id").alias("value"), F.lit(True).alias("taken")), ["doc_id", "value"], "left")
    free = next_ids(nodes).where("prefix = 'p'").select("doc_id", "next_id")
    moves = moves.join(free, "doc_id").select("doc_id", "seq", "op", "node_id", "value", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("taken", F.lit(False)).alias("taken"), "next_id")
    kind = nodes.schema["doc_id"].dataType

    def run(key, rows):
        log = sorted({tuple(r.values()) for r in rows.drop_columns(["doc_id"]).to_pylist()}, key=lambda r: (r[0], r[1], r[2] or "", r[3] or ""))
        after, root, born, dead = {}, {}, {}, {}
        number = log[0][-1]
        for seq, op, node, value, known, taken, _ in log:
            if node in dead or not (known or node in root):
                continue
            if op == "delete":
                dead[node] = known
                continue
            new = value or f"p{number}"
            if taken or new in root:
                continue
            if new[:1] == "p" and new[1:].isdecimal():
                number = max(number, int(new[1:]) + 1)
            after[new], after[node] = after.get(node), new
            root[new], born[new] = root.get(node, node), seq
        out = [(node, None, 0, None) for node, known in dead.items() if known]
        for anchor in dict.fromkeys(root.values()):
            node, place = after.get(anchor), 1
            while node is not None:
                if node not in dead:
                    out.append((node, anchor, place, born[node]))
                node, place = after.get(node), place + 1
        cols = list(zip(*out)) if out else [(), (), (), ()]
        doc = rows.column("doc_id")
        return pa.table([pa.array([key[0].as_py()] * len(out), doc.type), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["doc_id", "node_id", "root", "place", "born"])

    return moves.groupBy("doc_id").applyInArrow(run, f"doc_id {kind.simpleString()}, node_id string, root string, place long, born long")


def edited_children(paragraphs: DataFrame, texts: DataFrame) -> DataFrame:
    """Children of edited paragraphs as (doc_id, path, type, node_id, text, bold, size); a node_id that is to be made is null.

    paragraphs: doc_id, path, did; texts: the text nodes of the tree.
    """
    parent = F.slice("path", 1, F.size("path") - 1)
    kid = F.struct(F.element_at("path", -1).alias("k"), "node_id", "text", F.coalesce("bold", F.lit(False)).alias("bold"), F.col("size").cast("double").alias("size"))
    kids = texts.select("doc_id", parent.alias("path"), kid.alias("kid")).groupBy("doc_id", "path").agg(F.array_sort(F.collect_list("kid")).alias("kids"))
    none = F.array().cast("array<struct<k:bigint,node_id:string,text:string,bold:boolean,size:double>>")
    df = paragraphs.join(kids, ["doc_id", "path"], "left").withColumn("kids", F.coalesce("kids", none))
    did, first = F.col("did"), F.get("kids", 0)
    every, odd = F.forall("kids", lambda c: c["bold"]), did["flips"] % 2 == 1
    flipped = lambda b: F.when(did["flips"] == 0, b).otherwise(every != odd)
    fresh = did["emptied"] | (F.size("kids") == 0)
    one = lambda node_id, bold, size: F.array(F.struct(F.lit(0).cast("long").alias("k"), node_id.alias("node_id"), did["text"].alias("text"), bold.alias("bold"), size.alias("size")))
    after = did["odd"] == 1
    kids = (
        F.when(did["told"] & fresh, one(F.lit(None).cast("string"), after, did["later"]))
        .when(did["told"], one(first["node_id"], flipped(first["bold"]) != after, F.coalesce(did["later"], did["size"], first["size"])))
        .when(did["emptied"], none)
        .otherwise(F.transform("kids", lambda c: c.withField("bold", flipped(c["bold"])).withField("size", F.coalesce(did["size"], c["size"]))))
    )
    rows = df.select("doc_id", "path", F.inline(kids))
    return rows.select("doc_id", F.concat("path", F.array("k")).alias("path"), F.lit("text").alias("type"), "node_id", "text", "bold", "size")


def edit_tree(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """A tree of editor.nodes after all edits, each in its turn by seq.

    text reaches paragraphs anywhere, cells too: their children become one with
    the marks of the first, none if the text is empty; of a text node it sets that
    node's text before any edits of its paragraph. bold clears a paragraph
    whose children are all bold and else makes them bold; size sets the size of
    each child; these and align, list (level 0), insert and delete go to paragraphs
    at the top only, src and alt to images. insert makes a paragraph with an
    empty child behind node_id. Edits of what isn't there, yet or any more, do
    nothing, nor do null operations, sizes that are no numbers, or repeated edits.
    Inserted nodes get paths between those of their neighbours, so nothing is
    renumbered; a tree without nodes or a log without edits is fine.
    """
    edits = edits.select("doc_id", F.col("seq").cast("long").alias("seq"), "op", "node_id", F.col("value").cast("string").alias("value"))
    nodes = stored(nodes, "nodes")
    moved = stored(restructured(nodes, edits), "moved")
    at = nodes.select("doc_id", F.col("node_id").alias("root"), "path")
    new = moved.where("place > 0").join(at, ["doc_id", "root"]).select("doc_id", "node_id", F.concat("path", F.array(F.col("place") + BEHIND)).alias("path"), "born")
    made = new.select("doc_id", "node_id", "path", F.lit("paragraph").alias("type"), F.lit("left").alias("align"), F.lit("none").alias("list"), "born")
    child = new.select("doc_id", F.concat("path", F.array(F.lit(0).cast("long"))).alias("path"), F.lit("text").alias("type"), F.lit("").alias("text"), F.lit(False).alias("bold"))
    gone = moved.where("place = 0").join(nodes.select("doc_id", "node_id", F.col("path").alias("block")), ["doc_id", "node_id"]).select("doc_id", "block")
    left = nodes.withColumn("block", block_path()).join(gone, ["doc_id", "block"], "left_anti").drop("block")
    left = stored(left.unionByName(made, allowMissingColumns=True).unionByName(child, allowMissingColumns=True), "left")
    aims = left.where(F.col("type").isin("paragraph", "image", "text") & F.col("node_id").isNotNull()).select("doc_id", "node_id", "path", "type", (F.size(inner_path()) == 0).alias("top"), "born")
    paragraph = F.col("type") == "paragraph"
    reaches = F.when(F.col("op") == "text", F.col("type") != "image").when(F.col("op").isin("bold", "size", "align", "list"), paragraph & F.col("top")).when(F.col("op").isin("src", "alt"), F.col("type") == "image")
    log = edits.join(aims, ["doc_id", "node_id"]).where(reaches & (F.col("born").isNull() | (F.col("seq") > F.col("born"))))
    done = stored(folded(log, ["doc_id", "node_id"]), "done")
    edited = aims.where(paragraph).select("doc_id", "node_id", "path").join(done.select("doc_id", "node_id", "did"), ["doc_id", "node_id"])
    own = done.select("doc_id", "node_id", F.when(F.col("did.told"), F.col("did.text")).when(F.col("did.emptied"), "").alias("_text"))
    texts = left.where("type = 'text'").join(own, ["doc_id", "node_id"], "left").withColumn("text", F.coalesce("_text", "text")).select(*left.columns)
    same = texts.withColumn("of", F.slice("path", 1, F.size("path") - 1)).join(edited.select("doc_id", F.col("path").alias("of")), ["doc_id", "of"], "left_anti").drop("of")
    told = edited_children(edited.drop("node_id"), texts)
    others = left.where("type <> 'text'").join(done.drop("did").withColumnsRenamed({k: f"_{k}" for k in ("align", "list", "src", "alt")}), ["doc_id", "node_id"], "left")
    level = F.when(F.col("_list").isNull(), F.col("level")).when(F.col("_list") != "none", 0)
    others = others.withColumns({"level": level.cast(nodes.schema["level"].dataType), **{k: F.coalesce(f"_{k}", k) for k in ("align", "list", "src", "alt")}}).select(*left.columns)
    out = stored(others.unionByName(same).unionByName(told, allowMissingColumns=True).select(*nodes.columns), "edited")
    # Children that were made get the next free numbers, in document order.
    nameless = out.where("node_id IS NULL").withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("path")))
    free = next_ids(nodes).where("prefix = 'text'").select("doc_id", "next_id")
    named = nameless.join(free, "doc_id", "left").withColumn("node_id", F.concat(F.lit("text"), F.coalesce("next_id", F.lit(1)) + F.col("_n") - 1))
    return out.where("node_id IS NOT NULL").unionByName(named.select(*nodes.columns))


def apply_edits(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """nodes after all edits: a tree of editor.nodes as edit_tree has it, an outline without spans as edit_outline."""
    return edit_tree(nodes, edits) if "colspan" in nodes.columns else edit_outline(nodes, edits)


def paragraphs(tree: DataFrame) -> DataFrame:
    """(doc_id, node_id, path, text, bold, size, align, list) of paragraphs at the top: bold if there are children and all are, the first size of a child."""
    top = tree.where((F.col("type") == "paragraph") & (F.size(inner_path()) == 0)).select("doc_id", "node_id", "path", "align", "list")
    kid = F.struct("path", "text", "bold", "size")
    kids = tree.where("type = 'text'").select("doc_id", F.slice("path", 1, F.size("path") - 1).alias("path"), kid.alias("kid")).groupBy("doc_id", "path").agg(F.array_sort(F.collect_list("kid")).alias("kids"))
    df = top.join(kids, ["doc_id", "path"], "left")
    size = F.get(F.filter("kids", lambda c: c["size"].isNotNull()), 0)["size"]
    text = F.array_join(F.transform("kids", lambda c: c["text"]), "")
    return df.select("doc_id", "node_id", "path", F.coalesce(text, F.lit("")).alias("text"), F.coalesce(F.forall("kids", lambda c: c["bold"]), F.lit(False)).alias("bold"), size.alias("size"), "align", "list")


def first_paragraphs(tree: DataFrame) -> DataFrame:
    """(doc_id, node_id) of the first paragraph at the top, which is selected after a deletion."""
    top = tree.where((F.col("type") == "paragraph") & (F.size(inner_path()) == 0))
    return top.groupBy("doc_id").agg(F.min_by("node_id", "path").alias("node_id"))


def edit_outline(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """An outline, one row a paragraph with its text, after all edits: set values, toggles, deletions of paragraphs, insertions behind a node.

    A toggle makes a paragraph bold unless it is; a paragraph without text is not.
    An inserted node gets the value as its id, and stands before what was inserted
    earlier behind the same node. Paths gain ordinals, so nothing is renumbered.
    """
    made = edits.where("op = 'insert'").select("doc_id", F.col("node_id").alias("anchor"), F.col("value").alias("node_id"), "seq")
    at = nodes.select("doc_id", F.col("node_id").alias("anchor"), "path")
    order = Window.partitionBy("doc_id", "anchor").orderBy(F.desc("seq"))
    new = made.withColumn("_n", F.row_number().over(order).cast("long")).join(at, ["doc_id", "anchor"])
    new = new.select("doc_id", "node_id", F.concat("path", F.array("_n")).alias("path"), F.lit("paragraph").alias("type"), F.lit("").alias("text"), F.lit(False).alias("bold"), F.lit("left").alias("align"))
    left = nodes.unionByName(new, allowMissingColumns=True)
    done = fold(edits.where("op <> 'insert'"), ["doc_id", "node_id"]).withColumnsRenamed({k: f"_{k}" for k in (*SET, "bold", "deleted")})
    df = left.join(done, ["doc_id", "node_id"], "left").where(~F.coalesce("_deleted", F.lit(False)))
    text = F.coalesce("_text", "text")
    bold = (F.coalesce("bold", F.lit(False)) != F.coalesce("_bold", F.lit(False))) & (F.coalesce(text, F.lit("")) != "")
    out = df.withColumn("bold", bold)
    for k in SET:
        out = out.withColumn(k, F.coalesce(f"_{k}", F.col(k).cast("string")))
    return out.select(*nodes.columns)


def next_ids(nodes: DataFrame) -> DataFrame:
    """(doc_id, prefix, next_id): one more than the largest numeric suffix."""
    prefix, number = F.regexp_extract("node_id", r"^(\D*)\d+$", 1), F.regexp_extract("node_id", r"(\d+)$", 1)
    return nodes.groupBy("doc_id", prefix.alias("prefix")).agg((F.coalesce(F.max(number.try_cast("long")), F.lit(0)) + 1).alias("next_id"))
