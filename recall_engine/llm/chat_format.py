"""Chat formatting with typed content parts, in DataFrame expressions only.

A message is a row with a role and an array of typed parts. A visitor flattens each message: runs of text parts
are joined and escaped, all other parts become ordered placeholders, with an attachment reference and the number of tokens that
the placeholder stands for. The messages of a conversation become one string and one span a turn, which says
whether the turn's body lies under the loss mask.

Template: ``<|turn|>role<|body|>text<|end|>`` and a line feed, for each turn. Control strings inside roles and
texts get a backslash after their first character (one more if they have some already), which ``unescape`` takes
away again, so any text comes back unchanged and none can close or open a turn.

Defined results: null role or text counts as empty; a null or empty array of parts gives an empty body; null parts
inside it give nothing; parts of a type that is not known become ``<|file|>`` with no tokens; turns come in the
order of ``turn`` (nulls first), ties by role, then by rendered text, and repeated rows stay; a null conversation id
is a conversation of its own; extra columns are ignored. A conversation is one row of output, whatever its length:
its text is rendered before the shuffle, but its digest needs all of it in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
_REST = r"(?=\||/?s>|</?SYS>>|/?INST\])"
PARTS = "array<struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])(\\*)" + _REST, r"$1\\$2")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])\\(\\*)" + _REST, "$1$2")


def text_part(c: Column) -> Column:
    """An array of one text part."""
    none = {"type": F.lit("text"), "text": c}
    kinds = {"uri": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    cols = [v.alias(k) for k, v in none.items()] + [F.lit(None).cast(t).alias(k) for k, t in kinds.items()]
    return F.array(F.struct(*cols))


def _tokens(p: Column, patch: int, audio_rate: float, page_tokens: int) -> Column:
    side = lambda n: F.ceil(F.coalesce(p[n], F.lit(0)) / F.lit(patch))
    return (
        F.when(p["type"] == "image", side("width") * side("height"))
        .when(p["type"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * F.lit(float(audio_rate))))
        .when(p["type"] == "document", F.coalesce(p["pages"], F.lit(0)) * F.lit(page_tokens))
        .otherwise(F.lit(0))
        .cast("long")
    )


def _runs(z: Column) -> Column:
    """The body of parts whose places of other than text are ``stops``, with -1 before and their number after them."""

    def run(k: Column) -> Column:
        a, b = F.get(z["stops"], k), F.get(z["stops"], k + 1)
        said = F.array_join(F.transform(F.slice(z["parts"], a + 2, b - a - 1), lambda p: F.coalesce(p["text"], F.lit(""))), "")
        kind = F.get(z["parts"], b)["type"]
        mark = F.when(b >= F.size(z["parts"]), "").when(kind.isin("image", "audio", "document"), F.concat(F.lit("<|"), kind, F.lit("|>"))).otherwise("<|file|>")
        return F.concat(escape(said), mark)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.size(z["stops"]) - 2), run), "")


def flatten_parts(parts: Column, patch: int = 28, audio_rate: float = 25.0, page_tokens: int = 1024) -> Column:
    """struct<text, attachments: array<struct<type, uri, tokens>>, tokens> of an array of parts.

    An image stands for ceil(width / patch) * ceil(height / patch) tokens, audio for audio_rate tokens a second,
    a document for page_tokens a page. Attachments lie in the order of their placeholders.
    """
    known = F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: p.isNotNull())
    is_text = lambda p: F.coalesce(p["type"], F.lit("text")) == "text"
    stops = F.array_compact(F.transform(known, lambda p, i: F.when(~is_text(p), i)))
    # Text parts that stand side by side are escaped as one text, so no control string can be put together from them.
    body = F.transform(F.array(F.struct(known.alias("parts"), F.concat(F.array(F.lit(-1)), stops, F.array(F.size(known))).alias("stops"))), _runs)[0]
    others = F.filter(known, lambda p: ~is_text(p))
    refs = F.transform(
        others,
        lambda p: F.struct(p["type"].alias("type"), p["uri"].alias("uri"), _tokens(p, patch, audio_rate, page_tokens).alias("tokens")),
    )
    total = F.aggregate(refs, F.lit(0).cast("long"), lambda a, r: a + r["tokens"])
    return F.struct(body.alias("text"), refs.alias("attachments"), total.alias("tokens"))


def format_chat(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", loss_roles: tuple[str, ...] = ("assistant",), **sizes) -> DataFrame:
    """One row a conversation: conv, formatted, turns, attachments, placeholder_tokens.

    turns holds struct<role, start, end, loss> in order: the code points [start, end) of formatted are the turn's
    body, and loss says whether it is trained on. attachments adds the turn's index to each reference.
    """
    head = F.concat(F.lit(TURN), escape(F.coalesce(F.col(role), F.lit(""))), F.lit(BODY))
    rows = messages.select(
        F.col(conv).alias("_conv"),
        F.col(turn).alias("_turn"),
        F.coalesce(F.col(role), F.lit("")).alias("_role"),
        head.alias("_head"),
        flatten_parts(F.col(parts), **sizes).alias("_flat"),
    ).select("_conv", "_turn", "_role", "_flat", "_head", F.concat("_head", "_flat.text", F.lit(END + "\n")).alias("_out"))
    order = Window.partitionBy("_conv").orderBy("_turn", "_role", "_out")
    before = F.coalesce(F.sum(F.char_length("_out").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    start = F.col("_before") + F.char_length("_head")
    placed = rows.withColumns({"_seq": F.row_number().over(order), "_before": before}).select(
        "_conv",
        F.struct(
            "_seq",
            "_out",
            F.struct(
                F.col("_role").alias("role"),
                start.alias("start"),
                (start + F.char_length("_flat.text")).alias("end"),
                F.col("_role").isin(*loss_roles).alias("loss"),
            ).alias("span"),
            F.col("_flat.attachments").alias("refs"),
            F.col("_flat.tokens").alias("tokens"),
        ).alias("_t"),
    )
    turns = placed.groupBy("_conv").agg(F.array_sort(F.collect_list("_t")).alias("_ts"))
    return turns.select(
        F.col("_conv").alias(conv),
        F.array_join(F.transform("_ts", lambda t: t["_out"]), "").alias("formatted"),
        F.transform("_ts", lambda t: t["span"]).alias("turns"),
        F.flatten(
            F.transform(
                "_ts",
                lambda t: F.transform(t["refs"], lambda r: F.struct((t["_seq"] - 1).alias("turn_index"), r["type"].alias("type"), r["uri"].alias("uri"), r["tokens"].alias("tokens"))),
            )
        ).alias("attachments"),
        F.aggregate("_ts", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("placeholder_tokens"),
    )


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>>: what a formatted string says, unescaped. Placeholders stay as they are."""
    blocks = F.split(formatted, r"<\|end\|>\n", -1)
    return F.transform(
        F.slice(blocks, F.lit(1), F.size(blocks) - 1),
        lambda b: F.struct(
            unescape(F.replace(F.substring_index(b, BODY, 1), F.lit(TURN), F.lit(""))).alias("role"),
            unescape(F.substring_index(b, BODY, -1)).alias("text"),
        ),
    )


def digest(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Counts and digests of formatted conversations, read back from ``formatted`` and the loss mask alone."""
    read = chats.select(conv, "formatted", "turns", parse_turns(F.col("formatted")).alias("_read"))
    masked = F.transform(F.filter(F.arrays_zip(F.col("_read").alias("read"), F.col("turns").alias("span")), lambda z: z["span"]["loss"]), lambda z: z["read"]["text"])
    said = F.array_join(F.transform("_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.withColumn("_loss", F.array_join(masked, "")).select(
        conv,
        F.size("_read").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
