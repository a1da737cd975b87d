"""Text from attachments: what the bytes are, and the text of HTML, DOCX and plain text."""

from __future__ import annotations

import contextlib
import io
import re
import signal
import threading
import zipfile
from collections.abc import Iterator
from html import unescape
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recall_engine.sources.files import checkpointed

#: Limits of an extraction: bytes in, bytes of text out, seconds. Fixed values of the definition.
MOST_IN, MOST_OUT, MOST_SECONDS = 16 << 20, 1 << 20, 10.0
_BLOCK = frozenset("p div br li tr h1 h2 h3 h4 h5 h6".split())
_SKIP = frozenset(("script", "style", "noscript"))
_DOCX_TEXT = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def sniff(data: Column) -> Column:
    """pdf, docx, html, text, or an empty string, by the bytes, never by a name."""
    shown = lambda c: F.decode(c, "ISO-8859-1")
    low = F.lower(F.ltrim(shown(F.substring(data, 1, 4096)), F.lit(" \t\r\n")))
    html = low.startswith("<!doctype html") | low.startswith("<html") | low.contains("<body") | low.contains("<div") | low.contains("<p>")
    docx = (F.hex(F.substring(data, 1, 4)) == "504B0304") & shown(data).contains("word/document.xml")
    text = F.is_valid_utf8(data.cast("string")) & ~shown(data).contains("\0")
    return F.when(F.hex(F.substring(data, 1, 5)) == "255044462D", "pdf").when(docx, "docx").when(html, "html").when(text, "text").otherwise("")


#: Elements whose content isn't markup, up to their end tag.
_RAW = frozenset("script style noscript iframe noembed noframes xmp title textarea".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: In a tag, up to what ends it, or to a quote that a value begins with.
_IN_TAG = re.compile(r"""[^>"'=]*(?:=[\s]*["']|[>"'=])""")


def _tag_end(html: str, at: int) -> int:
    """The place after the > that ends a tag, or -1; quotes count where a value begins. Every character is looked at once."""
    while True:
        m = _IN_TAG.match(html, at)
        if m is None:
            return -1
        at, last = m.end(), m.group()[-1]
        if last == ">":
            return at
        if last in "\"'" and "=" in m.group():
            at = html.find(last, at) + 1
            if not at:
                return -1


def html_text(html: str) -> str:
    """The text, with a line feed where a block starts; no scripts, styles or fallbacks. One pass forward: what isn't closed
    reaches to the end and ends it."""
    parts: list[str] = []
    at = skipping = 0
    show = lambda text: parts.append(unescape(text) if "&" in text else text)
    while at < len(html):
        tag = html.find("<", at)
        if tag < 0:
            tag = len(html)
        if tag > at and not skipping:
            show(html[at:tag])
        at = tag
        if at + 1 >= len(html):
            if at < len(html) and not skipping:
                parts.append("<")
            break
        kind = html[at + 1]
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            at = len(html) if end < 0 else end + 3
        elif kind in "!?" or kind == "/" and not _NAME.match(html, at + 2):
            end = html.find(">", at)
            at = len(html) if end < 0 else end + 1
        elif m := _NAME.match(html, at + 1 + (kind == "/")):
            end = _tag_end(html, m.end())
            if end < 0:
                break
            name, at = m.group().lower(), end
            if kind == "/":
                skipping = max(0, skipping - (name in _SKIP))
            elif html[end - 2] != "/":  # a tag that closes itself starts no line
                skipping += name in _SKIP
                if name in _BLOCK and not skipping:
                    parts.append("\n")
                if name in _RAW:
                    close = re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE).search(html, at)
                    stop = close.start() if close else len(html)
                    if not skipping:
                        show(html[at:stop])
                    at = stop
        else:
            if not skipping:
                parts.append("<")
            at += 1
    return "".join(parts).strip()


def docx_text(data: bytes) -> str:
    """The runs of text of a document, a line for each paragraph."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        info = z.getinfo("word/document.xml")
        if info.file_size > MOST_IN:
            raise ValueError("document too large")
        root = ElementTree.fromstring(z.read(info))
    lines = ("".join(t.text or "" for t in p.iter(f"{_DOCX_TEXT}t")) for p in root.iter(f"{_DOCX_TEXT}p"))
    return "\n".join(x for x in lines if x)


class _TimedOut(Exception):
    pass


@contextlib.contextmanager
def limited(seconds: float) -> Iterator[None]:
    """Raises in the block once so many seconds are over. Signals reach the main thread alone, where Spark's workers run tasks; in
    any other thread there is no limit."""
    if threading.current_thread() is not threading.main_thread() or seconds <= 0:
        yield
        return

    def stop(*_) -> None:
        raise _TimedOut

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def extract(kind: str, data: bytes | None, seconds: float = MOST_SECONDS) -> tuple[bool, str, str]:
    """(ok, text, error) of one object, within so many seconds; never raises."""
    try:
        with limited(seconds):
            return _extracted(kind, data)
    except _TimedOut:
        return False, "", f"no end after {seconds:g} s"
    except Exception as e:  # one bad object must not end the job
        return False, "", f"{type(e).__name__}: {e}"[:200]


def _extracted(kind: str, data: bytes | None) -> tuple[bool, str, str]:
    if data is None or len(data) > MOST_IN:
        return False, "", "no data" if data is None else "too large"
    if kind not in EXTRACTORS:
        return False, "", f"no extractor for {kind or 'unknown data'}"
    text = EXTRACTORS[kind](data)
    while len(text.encode()) > MOST_OUT:
        text = text.encode()[:MOST_OUT].decode("utf-8", "ignore")
    return (True, text, "") if text else (False, "", "no text")


#: How each kind of data becomes text, and what that is called.
EXTRACTORS = {"html": lambda d: html_text(d.decode("utf-8", "replace")), "docx": docx_text, "text": lambda d: d.decode("utf-8").strip()}
TYPES = {"html": "sanitized_html", "docx": "office_text", "text": "plain", "pdf": "text_layer"}


def extract_all(objects: DataFrame, id_col: str = "object_hash", data_col: str = "data") -> DataFrame:
    """(id_col, kind, ok, text, error) of every object; the kind is told by expressions, the text by Arrow batches."""
    given = objects.select(id_col, F.col(data_col).cast("binary").alias("_d")).withColumn("kind", sniff(F.col("_d"))).select(id_col, "kind", "_d")
    id_type = objects.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [extract(k, d) for k, d in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            ok, text, error = (list(x) for x in zip(*done, strict=True)) if done else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_()), pa.array(text, pa.string()), pa.array(error, pa.string())], names=[id_col, "kind", "ok", "text", "error"])

    return given.mapInArrow(run, f"`{id_col}` {id_type}, kind string, ok boolean, text string, error string")


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the header of a PNG or GIF; None for anything else."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if re.match(rb"GIF8[79]a", data) and len(data) >= 10:
        return int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    return None


def work_queue(attachments: DataFrame, derivatives: DataFrame, objects: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Objects still without an outcome, with their data: what the next extraction run works on. A failure is an outcome, unless it
    is to be tried again."""
    kept = ~F.col("invalidated")
    done = derivatives.filter(kept & (F.col("status") == "ok") if retry_failed else kept).select("object_hash")
    return attachments.select("object_hash").distinct().join(done, "object_hash", "left_anti").join(objects, "object_hash")


def extraction_requests(queue: DataFrame, version: str = "1", actor: str = "enricher") -> dict[str, DataFrame]:
    """Requests for ``events.build`` that record the outcome of every object of a queue once: a text, or a failure with its reason. Objects
    are worked on where they lie. A derivative's id follows from object, type and version, so a run that is repeated asks for the same
    events, and what is folded in leaves the queue."""
    done = checkpointed(extract_all(queue))
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])[F.col("kind")], F.lit("unknown"))
    named = done.select(F.lit(actor).alias("actor"), F.xxhash64("object_hash").alias("at"), F.left(F.sha2(F.concat_ws("\x1f", F.col("object_hash").cast("string"), kind, F.lit(version)), 256), F.lit(32)).alias("derivative_id"), F.col("object_hash").cast("string").alias("blob_hash"), kind.alias("derivative_type"), "ok", "text", "error")
    good = named.filter("ok").drop("ok", "error").withColumn("extractor", F.concat(F.col("derivative_type"), F.lit(f"/{version}")))
    return {"derivative.publish": good, "derivative.fail": named.filter("NOT ok").drop("ok", "text")}


def check_summaries(summaries: DataFrame, bodies: DataFrame, least: float = 0.5) -> DataFrame:
    """(message_id, sim_bp, agrees): a sender's summary against the body, by the cosine of their vectors.
    summaries and bodies: message_id, vector."""
    from recall_engine.operators.vectors import dot

    both = summaries.select("message_id", F.col("vector").alias("_a")).join(bodies.select("message_id", F.col("vector").alias("_b")), "message_id")
    sim = dot(F.col("_a"), F.col("_b"))
    return both.select("message_id", (sim * 10000).cast("int").alias("sim_bp"), (sim >= least).alias("agrees"))
