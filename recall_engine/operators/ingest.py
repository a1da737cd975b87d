"""Import of file trees: what is new, changed or the same, its topics and links, and three-way merges."""

from __future__ import annotations

import difflib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recall_engine.functions.text import normalise_newlines, proposed_topics, wiki_links, wiki_name


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of all Markdown files below root, without those in folders whose names begin with a dot."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select("value", F.col("_metadata.file_path").alias("_f"))
    at = F.substring_index(F.col("_f"), "/" + root.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    return raw.select(at.alias("path"), normalise_newlines(F.col("value")).alias("text")).filter(~F.col("path").rlike(r"(^|/)\.[^/]"))


def plan(files: DataFrame, label: str = "notes") -> DataFrame:
    """Files with their hash, the topics of the tree and its folders, and the targets of their links."""
    return files.select("path", "text", F.sha2(F.col("text"), 256).alias("body_hash"), proposed_topics(F.lit(label), F.col("path")).alias("topics"), wiki_links(F.col("text")).alias("links"))


def classify(files: DataFrame, source_refs: DataFrame) -> DataFrame:
    """(path, action, message_id): publish what has no reference, revise what has another hash, skip the rest."""
    known = source_refs.select("path", "message_id", F.col("body_hash").alias("_old"))
    out = files.select("path", "body_hash").join(known, "path", "left")
    action = F.when(F.col("message_id").isNull(), "publish").when(F.col("_old") != F.col("body_hash"), "revise").otherwise("skip")
    return out.select("path", action.alias("action"), "message_id")


def report(classified: DataFrame) -> DataFrame:
    return classified.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def resolve_links(planned: DataFrame) -> DataFrame:
    """(path, link, target): links to the file whose name, without folders and ending, is the link; null for none. Of
    several the first path counts."""
    name = wiki_name(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md\z", ""))
    targets = planned.groupBy(name.alias("link")).agg(F.min("path").alias("target"))
    return planned.select("path", F.explode("links").alias("link")).join(targets, "link", "left").select("path", "link", "target")


def export_text(path: Column, message_id: Column, body: Column) -> Column:
    """A Markdown file with front matter."""
    return F.concat(F.lit("---\nsource: "), path, F.lit("\nmessage: "), message_id, F.lit("\n---\n"), body)


def parse_export(c: Column) -> Column:
    """struct<source, message, body> of such a file; nulls where there is no front matter."""
    field = lambda name: F.nullif(F.regexp_extract(c, rf"\A---\n(?:[^\n]*\n)*?{name}: ([^\n]*)\n(?:[^\n]*\n)*?---\n", 1), F.lit(""))
    body = F.regexp_replace(c, r"\A---\n(?:[^\n]*\n)*?---\n", "")
    return F.struct(field("source").alias("source"), field("message").alias("message"), body.alias("body"))


def front_matter(c: Column, keys: tuple[str, ...]) -> Column:
    """The named fields of a fenced block at the start, nulls where missing."""
    block = F.regexp_extract(c, r"(?s)\A```yaml\n(.*?)\n```", 1)
    return F.struct(*[F.nullif(F.trim(F.regexp_extract(block, rf"(?m)^{k}:\s*(.*)$", 1)), F.lit("")).alias(k) for k in keys])


#: Lines of a stretch without anchors that are aligned by comparing all with all.
STRETCH = 2000


def _anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of lines that stand once in each list, as many as keep their order in both: the longest rising run of places."""
    once = lambda x: {line: i for i, line in enumerate(x) if counts[id(x)][line] == 1}
    counts = {id(x): Counter(x) for x in (a, b)}
    other = once(b)
    pairs = [(i, other[line]) for line, i in once(a).items() if line in other]
    ends: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(ends, j)
        before[n] = last[at - 1] if at else -1
        ends[at : at + 1], last[at : at + 1] = [j], [n]
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def edits(a: list[str], b: list[str]) -> list[tuple[int, int, int, int]]:
    """(i, j, k, m): stretches a[i:j] that b has as b[k:m] instead. Equal ends are set aside, then stretches between lines that stand
    once in each are aligned on their own; what is left is compared in full if it is short, and else counts as replaced."""
    out, stack = [], [(0, len(a), 0, len(b))]
    while stack:
        i, j, k, m = stack.pop()
        while i < j and k < m and a[i] == b[k]:
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
        if i == j and k == m:
            continue
        found = _anchors(a[i:j], b[k:m]) if i < j and k < m else []
        if found:
            x, y = i, k
            for p, q in [*((i + p, k + q) for p, q in found), (j, m)]:
                stack.append((x, p, y, q))
                x, y = p + 1, q + 1
        elif i < j and k < m and max(j - i, m - k) <= STRETCH:
            same = difflib.SequenceMatcher(None, a[i:j], b[k:m], autojunk=False)
            out += [(i + p, i + q, k + r, k + t) for op, p, q, r, t in same.get_opcodes() if op != "equal"]
        else:
            out.append((i, j, k, m))
    return sorted(out)


def merge3(base: str, ours: str, theirs: str) -> tuple[str, bool]:
    """(text, clean): both sides' changes to base, line by line. Changes that touch the same lines and differ are kept
    between conflict marks."""
    if ours == theirs or theirs == base:
        return ours, True
    if ours == base:
        return theirs, True
    b, a, c = (x.splitlines(keepends=True) for x in (base, ours, theirs))
    changes: list = []
    for side, lines in ((0, a), (1, c)):
        changes += [[i, j, side, lines[k:m]] for i, j, k, m in edits(b, lines)]
    changes.sort(key=lambda e: (e[0], e[1], e[2]))
    out, at, clean, n = [], 0, True, 0
    while n < len(changes):
        group, end = [changes[n]], changes[n][1]
        n += 1
        while n < len(changes) and (changes[n][0] < end or changes[n][0] == group[0][0] == changes[n][1] or changes[n][0] == end and changes[n][0] == changes[n][1]):
            group.append(changes[n])
            end = max(end, changes[n][1])
            n += 1
        start = group[0][0]
        out += b[at:start]
        sides = []
        for side in (0, 1):
            text, pos = [], start
            for i, j, s, new in group:
                if s == side:
                    text += b[pos:i] + new
                    pos = j
            sides.append(text + b[pos:end])
        touched = {s for *_, s, _ in group}
        if len(touched) == 1:
            out += sides[touched.pop()]
        elif sides[0] == sides[1]:
            out += sides[0]
        else:
            clean = False
            out += ["<<<<<<< ours\n", *sides[0], "=======\n", *sides[1], ">>>>>>> theirs\n"]
        at = end
    return "".join(out + b[at:]), clean


OUTCOMES = ("rejected", "unchanged", "revised", "merged", "conflict")


def take_edits(edited: DataFrame, messages: DataFrame, revisions: DataFrame) -> DataFrame:
    """What becomes of edited exports: the columns of edited with outcome, reason, text (of a conflict that with its marks) and
    revisions, the payload of one message.revise_body event, null for none.

    edited: message_id, base_revision_id, body_hash, body; messages: message_id, head_revision_id, retracted; revisions: revision_id,
    message_id, body. An edit is rejected if its base isn't a revision of its message, the base's body doesn't have the hash that
    the export states, or the message was retracted; it is unchanged if it says what the head says. If the head is still the base
    it is one revision. If the head moved on, both are merged line by line: a clean merge is two revisions, the edit with
    the base as parent and the merged text with the edit and the head as parents; else it is a conflict. Ids of
    revisions follow from what they say and come from. Line ends become line feeds; null bodies are empty.
    """
    body = lambda c: normalise_newlines(F.coalesce(F.col(c), F.lit("")))
    base = revisions.select(F.col("revision_id").alias("base_revision_id"), F.col("message_id").alias("_of"), body("body").alias("_base"))
    heads = messages.select("message_id", F.col("head_revision_id").alias("_head"), F.col("retracted").alias("_gone"))
    held = revisions.select(F.col("revision_id").alias("_head"), body("body").alias("_current"))
    rows = edited.withColumn("_own", body("body")).join(base, "base_revision_id", "left").join(heads, "message_id", "left").join(held, "_head", "left")
    reason = (
        F.when(F.col("_of").isNull(), "no such base")
        .when(~F.col("_of").eqNullSafe(F.col("message_id")), "base of another message")
        .when(~F.col("body_hash").eqNullSafe(F.sha2("_base", 256)), "hash of the base")
        .when(F.col("_head").isNull() | F.col("_current").isNull(), "no such message")
        .when(F.col("_gone"), "retracted")
    )
    decided = F.when(F.col("reason").isNotNull(), "rejected").when(F.col("_own") == F.col("_current"), "unchanged").when(F.col("_head").eqNullSafe(F.col("base_revision_id")), "revised")
    rows = rows.withColumn("reason", reason).withColumn("outcome", decided)
    out = T.StructType([*rows.schema.fields, T.StructField("text", T.StringType())])
    named = [f.name for f in rows.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            outcome, text = b.column(named.index("outcome")).to_pylist(), b.column(named.index("_own")).to_pylist()
            for i, known in enumerate(outcome):
                if known is None:
                    text[i], clean = merge3(*(b.column(named.index(c))[i].as_py() for c in ("_base", "_current", "_own")))
                    outcome[i] = "merged" if clean else "conflict"
            cols = [pa.array(outcome, pa.string()) if n == "outcome" else b.column(i) for i, n in enumerate(named)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(text, pa.string())], names=out.names)

    merged = rows.mapInArrow(run, out)
    name = lambda *parts: F.left(F.sha2(F.concat_ws("\x1f", *parts), 256), F.lit(32))
    revision = lambda i, parents, c: F.struct(i.alias("revision_id"), parents.cast("array<string>").alias("parents"), F.sha2(F.col(c), 256).alias("body_hash"), F.col(c).alias("body"), F.octet_length(c).cast("long").alias("body_len"))
    branch = name("message_id", "base_revision_id", "_own")
    one = revision(branch, F.array("base_revision_id"), "_own")
    two = revision(name("message_id", "_head", branch, "text"), F.array(branch, F.col("_head").cast("string")), "text")
    # a merge that adds nothing to the edit is still the head that follows both
    listed = F.when(F.col("outcome") == "revised", F.array(one)).when(F.col("outcome") == "merged", F.array(one, two))
    kept = [f"`{c}`" for c in edited.columns if c not in ("outcome", "reason", "text", "revisions")]
    return merged.select(*kept, "outcome", "reason", "text", listed.alias("revisions"))


def edit_requests(taken: DataFrame, actor: str = "operator") -> dict[str, DataFrame]:
    """Requests for ``events.build``: one revision event for each edit that was taken."""
    wanted = taken.filter("revisions IS NOT NULL")
    return {"message.revise_body": wanted.select(F.lit(actor).alias("actor"), F.xxhash64("message_id", "base_revision_id").alias("at"), F.col("message_id").cast("string").alias("message_id"), "revisions")}


def ingest_requests(planned: DataFrame, classified: DataFrame, topics: DataFrame, actor: str = "operator") -> dict[str, DataFrame]:
    """Requests for ``events.build`` that carry out a plan: new files are published, changed ones revised, topics that the plan names
    and aren't there are made, and new messages linked to theirs.

    planned: as ``plan`` gives it; classified: as ``classify`` does; topics: topic_id, name. Ids follow from paths, texts and names, so
    carrying a plan out again asks for the same events. Requests of a kind are in the order of topics, messages, links.
    """
    name = lambda *parts: F.left(F.sha2(F.concat_ws("\x1f", *parts), 256), F.lit(32))
    at = lambda step: (F.lit(step).cast("long") * (1 << 40) + F.pmod(F.xxhash64("path"), F.lit(1 << 40))).alias("at")
    todo = planned.join(classified.select("path", "action", "message_id"), "path")
    own = name(F.lit("message"), "path")
    new = todo.filter("action = 'publish'").withColumn("message_id", own)
    size = F.octet_length("text").cast("long").alias("body_len")
    publish = new.select(F.lit(actor).alias("actor"), at(2), "message_id", name(F.lit("revision"), "path", "body_hash").alias("revision_id"), "body_hash", F.col("text").alias("body"), size, F.lit("canonical").alias("text_class"), F.col("path").alias("source_path"))
    changed = todo.filter("action = 'revise'")
    revision = F.struct(name(F.lit("revision"), "path", "body_hash").alias("revision_id"), F.array().cast("array<string>").alias("parents"), "body_hash", F.col("text").alias("body"), size)
    revise = changed.select(F.lit(actor).alias("actor"), at(2), F.col("message_id").cast("string").alias("message_id"), F.array(revision).alias("revisions"))
    wanted = new.select("path", "message_id", F.explode("topics").alias("name"))
    fresh = wanted.groupBy("name").agg(F.min("path").alias("path")).join(topics.select("name").distinct(), "name", "left_anti")
    create = fresh.select(F.lit(actor).alias("actor"), at(1), name(F.lit("topic"), "name").alias("topic_id"), "name")
    known = topics.groupBy("name").agg(F.min("topic_id").cast("string").alias("topic_id"))
    linked = wanted.join(known, "name", "left").withColumn("topic_id", F.coalesce("topic_id", name(F.lit("topic"), "name")))
    link = linked.select(F.lit(actor).alias("actor"), at(3), name(F.lit("link"), "message_id", "topic_id").alias("link_id"), "message_id", "topic_id", F.lit(False).alias("protected"))
    return {"topic.create": create, "message.publish": publish, "message.revise_body": revise, "topic.link.add": link}
