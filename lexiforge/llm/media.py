"""Media columns of interleaved documents.

A page becomes an ordered sequence of text and media-reference structs; references name payloads by
digest, and a join on the digest resolves each to what was read from its payload. Payloads are held
once for each digest, however many documents refer to them.
"""

from __future__ import annotations

import hashlib
import html
import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .dom import BLOCK, Node, parse

ITEM = "struct<position:int,kind:string,text:string,digest:string,caption:string>"
_MEDIA = frozenset("img audio video source embed object".split())
_SKIPPED = frozenset("script style head title noscript template".split())
_DIGEST = re.compile(r"^sha256:([0-9a-f]{64})$")
SAMPLE_RATE = 8000


def wave(payload: bytes, rate: int = SAMPLE_RATE) -> bytes:
    """A RIFF/WAVE file of the bytes as 8-bit mono samples. Its sizes have 32 bits; a Spark value is under 2 GiB."""
    pad = b"\0" * (len(payload) % 2)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    body = b"WAVE" + fmt + struct.pack("<4sI", b"data", len(payload)) + payload + pad
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def samples(stored: bytes) -> bytes:
    """The samples of an 8-bit mono WAVE file."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("no WAVE file")
    at, is_8_bit = 12, False
    while at + 8 <= len(stored):
        name, size = stored[at : at + 4], int.from_bytes(stored[at + 4 : at + 8], "little")
        if name == b"fmt ":
            is_8_bit = struct.unpack_from("<HH", stored, at + 8) == (1, 1) and struct.unpack_from("<H", stored, at + 22) == (8,)
        elif name == b"data":
            if not is_8_bit or at + 8 + size > len(stored):
                break
            return stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no 8-bit mono samples")


def payload_of(text: str | None) -> tuple[int, bytes]:
    """The text's UTF-8 length, and its bytes with zeros up to a positive multiple of 64."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
    return len(raw), raw + b"\0" * ((-len(raw)) % 64 if raw else 64)


def features(payload: bytes) -> str:
    """Level, spread and zero crossings of the samples around the middle value."""
    x = np.frombuffer(payload, np.uint8)
    total, squares = int(x.sum(dtype=np.int64)), int((x.astype(np.uint32) ** 2).sum(dtype=np.int64))
    mean = total / len(x)
    high = x >= 128
    crossings = int((high[1:] != high[:-1]).sum())
    return f"mean={mean:.6f};rms={(squares / len(x)) ** 0.5:.6f};peak={int(x.max())};crossings={crossings}"


def sequence_of(page: str | None) -> list[dict]:
    """Ordered items of a page: blocks of text, and references to media with their captions.

    A caption is the figcaption of the figure around the reference, else the alt text. A null or empty
    page gives no items; a reference without a digest keeps its place, with a null digest.
    """
    if not page:
        return []
    root, _ = parse(page)
    items: list[dict] = []
    inline: list[str] = []

    def end_text() -> None:
        text = " ".join("".join(inline).split())
        inline.clear()
        if text:
            items.append({"position": len(items), "kind": "text", "text": text, "digest": None, "caption": None})

    def text_within(node: Node) -> str:
        out, todo = [], [node]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo.extend(reversed(x.children))
        return " ".join("".join(out).split())

    def caption_of(node: Node, alt: str) -> str | None:
        up = node.parent
        while up is not None and up.tag != "figure":
            up = up.parent
        if up is not None:
            for child in up.children:
                if isinstance(child, Node) and child.tag == "figcaption":
                    return text_within(child)
        return alt or None

    todo: list = [root]
    while todo:
        item = todo.pop()
        if item is None:
            end_text()
        elif isinstance(item, str):
            inline.append(item)
        elif item.tag in _MEDIA:
            attrs = item.attributes()
            source = attrs.get("src") or attrs.get("data") or ""
            if source:
                end_text()
                m = _DIGEST.match(source)
                caption = caption_of(item, attrs.get("alt", ""))
                items.append({"position": len(items), "kind": "media", "text": None, "digest": m.group(1) if m else None, "caption": caption})
            todo.extend(reversed(item.children))
        elif item.tag == "figcaption" and any(isinstance(c, Node) and c.tag in _MEDIA for c in item.parent.children):
            continue  # it travels with its reference
        elif item.tag not in _SKIPPED:
            if item.tag in BLOCK:
                end_text()
                todo.append(None)
            elif item.tag == "br":
                inline.append(" ")
            todo.extend(reversed(item.children))
    end_text()
    return items


def parse_sequences(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, items): the item structs of each page, in order."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "items": [sequence_of(p) for p in batch["html"]]})

    narrow = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html"))
    return narrow.mapInPandas(run, f"id long, items array<{ITEM}>")


def read_payloads(media: DataFrame) -> DataFrame:
    """What the stored form of each distinct (digest, media) holds: the digest's row, once.

    A stored form that does not have the digest that it is filed under raises an error.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for digest, stored in zip(batch["digest"], batch["media"]):
                if hashlib.sha256(stored).hexdigest() != digest:
                    raise ValueError(f"a payload does not have its digest {digest}")
                payload = samples(stored)
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), digest, features(payload)))
            yield pd.DataFrame(rows, columns=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    distinct = media.groupBy("digest").agg(F.first("media").alias("media"))
    return distinct.mapInPandas(
        run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def resolve(sequences: DataFrame, contents: DataFrame) -> DataFrame:
    """One row per item: id, position, kind, text, caption, digest, and for media what its digest's row of contents holds.

    Text items and references that resolve to nothing keep their row, with nulls.
    """
    items = sequences.select("id", F.inline("items"))
    return items.join(contents, "digest", "left")


def page_of(text: str | None, n_bytes: int, digest: str) -> str:
    """The lines of a text as paragraphs, with its sound in their middle: a figure with a caption of its size."""
    lines = [f"<p>{html.escape(line)}</p>" for line in (text or "").split("\n")]
    figure = f'<figure><audio src="sha256:{digest}"></audio><figcaption>{n_bytes} bytes</figcaption></figure>'
    middle = len(lines) // 2
    return "".join(["<article>", *lines[:middle], figure, *lines[middle:], "</article>"])


def documents_as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pages, media): each text stored as a sound file, and a page of its lines with a reference to it by digest.

    Null texts count as empty, and whole texts are stored, however long. Repeated texts give one digest; an empty
    table gives no rows; null ids stay null. Other columns, whatever their names, are not looked at.
    """

    def run(with_media: bool):
        def each(batches):
            for batch in batches:
                rows = []
                for i, text in zip(batch["id"], batch["text"]):
                    n, payload = payload_of(text)
                    stored = wave(payload)
                    digest = hashlib.sha256(stored).hexdigest()
                    rows.append((digest, stored) if with_media else (i, page_of(text, n, digest)))
                yield pd.DataFrame(rows, columns=["digest", "media"] if with_media else ["id", "html"])

        return each

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInPandas(run(False), "id long, html string"), narrow.mapInPandas(run(True), "digest string, media binary")


def query(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "media")
    pages, media = documents_as_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    # features are small: a digest that very many documents share moves no payload twice
    contents = scratch.store(read_payloads(media), "contents")
    sequences = parse_sequences(pages, "id", "html").select("id", F.size("items").alias("n_items"), F.filter("items", lambda x: x["kind"] == "media").alias("items"))
    items = sequences.select("id", "n_items", F.inline("items")).join(contents, "digest", "left")
    n_bytes = F.regexp_extract("caption", r"^(\d+) bytes$", 1).cast("long")
    return items.select(
        F.col("id").alias("doc_id"), n_bytes.alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "n_items"
    )
