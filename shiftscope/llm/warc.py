"""Derived WARC records: each response gives a metadata and a plain-text conversion record.

Both derived records name their source in WARC-Refers-To (with its URI and date), carry over the
source's WARC headers that describe the capture, and are linked with each other.  The metadata block
holds every WARC header of the source as it stands, the HTTP status and headers, the digests the source states and
whether they hold.  Transfer and content encodings of the body (chunked; gzip, deflate, zstd) are undone before the
text is taken; an encoding that is unknown or does not hold is named, and the body is read as it stands.
Record ids are derived from the source's id, so a task that runs again makes the same records."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import gathered

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
#: headers of the capture that derived records carry over as they stand
CARRIED = ("WARC-Target-URI", "WARC-Date", "WARC-Warcinfo-ID", "WARC-IP-Address", "WARC-Identified-Payload-Type", "WARC-Truncated")
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.DOTALL | re.IGNORECASE)
_BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|"
                    r"li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>", re.IGNORECASE)
_TAG = re.compile(r"<[a-zA-Z/!?](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:>|\Z)|<[a-zA-Z/!?][^>]*(?:>|\Z)")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.DOTALL | re.IGNORECASE)
_CHARSET = re.compile(r"charset=[\"']?([\w.:-]+)", re.IGNORECASE)


def headers(raw: bytes) -> tuple[str, list[tuple[str, str]]]:
    """First line and fields of a header block; a line that starts with white space continues the one before."""
    lines = raw.decode("utf-8", "replace").split("\r\n")
    fields: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in " \t" and line.strip() and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            fields.append((name.strip(), value.strip()))
    return lines[0], fields


def field(fields: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in fields if k.lower() == name.lower()), None)


def digest_holds(stated: str | None, data: bytes) -> str:
    """``ok``, ``differs``, or ``unknown`` for an absent digest or another algorithm; hex and base32 forms."""
    if not stated or ":" not in stated:
        return "unknown"
    kind, _, value = stated.partition(":")
    kind = kind.lower().replace("-", "")
    if kind not in ("sha1", "sha256", "md5"):
        return "unknown"
    own = hashlib.new(kind, data).digest()
    return "ok" if value.lower() == own.hex() or value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=") else "differs"


def unchunked(body: bytes) -> bytes | None:
    """The data of a chunked body; None if it is not whole and well formed."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,16}", size):
            return None
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n:at + n + 2] != b"\r\n":
            return None
        out.append(body[at:at + n])
        at += n + 2


def _inflated(data: bytes, bits: int) -> bytes:
    out = []
    while data:
        step = zlib.decompressobj(bits)
        out.append(step.decompress(data) + step.flush())
        if not step.eof:
            raise ValueError("cut off")
        data = step.unused_data if bits == 31 and step.unused_data.startswith(b"\x1f\x8b") else b""
    return b"".join(out)


def decoded(body: bytes, fields: list[tuple[str, str]]) -> tuple[bytes, bytes, list[str]]:
    """The body without its transfer encoding, that without its content encodings too, and the encodings that
    could not be undone (the last one applied is undone first; from one that cannot be undone on, all stay)."""
    failed: list[str] = []

    def undo(data: bytes, name: str) -> bytes:
        codings = [x.strip().lower() for k, v in fields if k.lower() == name for x in v.split(",") if x.strip()]
        while codings:
            coding, plain = codings[-1], None
            try:
                if coding == "identity":
                    plain = data
                elif coding == "chunked":
                    plain = unchunked(data)
                elif coding in ("gzip", "x-gzip"):
                    plain = _inflated(data, 31)
                elif coding == "deflate":
                    try:
                        plain = _inflated(data, 15)
                    except (zlib.error, ValueError):
                        plain = _inflated(data, -15)
                elif coding == "zstd":
                    plain = zstandard.ZstdDecompressor().decompressobj().decompress(data)
            except (zlib.error, ValueError, zstandard.ZstdError):
                plain = None
            if plain is None:
                failed.extend(reversed(codings))
                break
            data = plain
            codings.pop()
        return data

    entity = undo(body, "transfer-encoding")
    return entity, undo(entity, "content-encoding") if not failed else entity, failed


def plain_text(source: str) -> str:
    """Visible text, one line per block, white space inside a line as one space."""
    source = _HIDDEN.sub(" ", source)
    source = _TAG.sub("", _BLOCK.sub("\n", source.replace("\r", " ").replace("\n", " ")))
    lines = (" ".join(x.split()) for x in html.unescape(source).split("\n"))
    return "\n".join(x for x in lines if x)


def record(kind: str, record_id: str, content_type: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    digest = "sha256:" + hashlib.sha256(block).hexdigest()
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), *fields, ("WARC-Block-Digest", digest),
            ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def derive(raw: bytes | None) -> list[tuple[str, str, str, str | None, str, int, bytes]]:
    """``(type, id, refers-to, target uri, block digest, block length, record)`` of the records derived from
    one response record; none from NULL, from other record types or from bytes that are no WARC record."""
    if not raw or not raw.startswith(b"WARC/"):
        return []
    head, found, rest = raw.partition(b"\r\n\r\n")
    _, fields = headers(head)
    source = field(fields, "WARC-Record-ID")
    if not found or not source or (field(fields, "WARC-Type") or "").lower() != "response":
        return []
    length = field(fields, "Content-Length") or ""
    block = rest[:int(length)] if length.isdigit() else rest.removesuffix(b"\r\n\r\n")
    http, _, body = block.partition(b"\r\n\r\n")
    status, http_fields = headers(http)
    kind = field(http_fields, "Content-Type") or ""
    entity, content, failed = decoded(body, http_fields)
    charset = (m[1] if (m := _CHARSET.search(kind)) else "utf-8")
    try:
        page = content.decode(charset, "replace")
    except LookupError:
        page = content.decode("utf-8", "replace")
    ids = {t: f"<urn:uuid:{uuid.uuid5(_SPACE, f'{source} {t}')}>" for t in ("metadata", "conversion")}
    carried = [(k, v) for k in CARRIED if (v := field(fields, k)) is not None]
    carried += [("WARC-Refers-To", source)]
    carried += [(f"WARC-Refers-To-{k}", v) for k in ("Target-URI", "Date") if (v := field(fields, f"WARC-{k}")) is not None]
    markup = "html" in kind.lower() or not kind
    text = (plain_text(page) if markup else page).encode("utf-8", "replace")
    about = [("http-status", status)]
    about += [("http-header", f"{k}: {v}") for k, v in http_fields]
    about += [("source-header", f"{k}: {v}") for k, v in fields]
    about += [("encoding-not-undone", x) for x in failed]
    for name, datas in (("WARC-Block-Digest", (block,)), ("WARC-Payload-Digest", (body, entity))):
        stated = field(fields, name)
        about += [(f"source-{name[5:].lower()}", stated)] if stated else []
        # a payload digest may have been taken with or without the transfer encoding
        checks = [digest_holds(stated, data) for data in datas]
        about += [(f"source-{name[5:].lower()}-check", "ok" if "ok" in checks else checks[0])]
    if markup and (m := _TITLE.search(page)):
        about += [("title", " ".join(html.unescape(m[1]).split()))]
    about += [("conversion-record", ids["conversion"]), ("text-length", str(len(text)))]
    meta = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in about).encode()
    out = []
    for t, content_type, more, data in (
            ("metadata", "application/warc-fields", [("WARC-Concurrent-To", ids["conversion"])], meta),
            ("conversion", "text/plain; charset=UTF-8", [("WARC-Concurrent-To", ids["metadata"])], text)):
        out.append((t, ids[t], source, field(fields, "WARC-Target-URI"), "sha256:" + hashlib.sha256(data).hexdigest(), len(data),
                    record(t, ids[t], content_type, carried + more, data)))
    return out


OUT = "record_type string, record_id string, refers_to string, target_uri string, block_digest string, block_length long, record binary"


def derived_records(records: DataFrame, key: str = "page_id", column: str = "record") -> DataFrame:
    """``(<key>, record binary)`` -> ``(<key>, record_type, record_id, refers_to, target_uri, block_digest,
    block_length, record)``: two rows per response record, in whole.  Repeated rows give repeated results;
    NULL and malformed records give none; other columns, also clashing ones, are not read.  Very long records
    are read whole, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, "record", 4 << 20):
            keys, rows = [], []
            for k, raw in zip(batch.column("key").to_pylist(), batch.column("record").to_pylist()):
                made = derive(raw)
                keys += [k] * len(made)
                rows += made
            types = [pa.string()] * 5 + [pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))],
                                             ["key", *(x.split()[0] for x in OUT.split(", "))])

    return records.select(F.col(key).cast("long").alias("key"), F.col(column).alias("record")).mapInArrow(run, f"key long, {OUT}") \
        .withColumnRenamed("key", key)
