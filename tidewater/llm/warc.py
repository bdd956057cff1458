"""WARC archives: an index with the place of every record, and coalesced byte-range reads through it.

Each task writes its records to archives of its own (gzip, one member a record, so every record can be read
alone) and hands on one index row per record: archive, offset, length, URL, payload digest. Archives
get a fresh name for every attempt of a task and the index names only those of attempts that Spark has
committed, so a lost executor or a repeated task leaves no wrong record behind, only an unnamed file.
Reading takes index rows, however selected, sorts them by archive and offset, reads neighbouring ranges
with one request and cuts the records out.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import attach_by_key
from tidewater.session import cut_lineage, scratch_path

# Bytes at which a task opens its next archive.
ARCHIVE_BYTES = 1 << 28
# Ranges are read together across gaps of up to this many bytes, in requests of up to the second number.
GAP_BYTES, REQUEST_BYTES = 1 << 16, 1 << 23
# Payloads below this many bytes are never told apart from copies: each is a response of its own.
LEAST_SHARED = 100
# Copies of one row that a task may write one after the other.
PIECE = 1000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, length long, url string, digest string, record_id string, type string"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"


def _one_line(text: str) -> str:
    """A header value: control characters and blanks are percent-encoded, as URLs do."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def _quoted(key: str | None) -> str | None:
    return None if key is None else quote(key, safe="")


def _unquoted(key: str | None) -> str | None:
    return None if key is None else unquote(key)


def record(kind: str, name: str, fields: dict[str, str | None], size: int, body: bytes) -> bytes:
    """One record as WARC/1.1 has it. A revisit has the HTTP header with the payload's length, and no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + body
    lines = {
        "WARC-Type": kind, "WARC-Record-ID": name, "WARC-Date": DATE, **fields,
        "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(http)),
    }
    head = "".join(f"{k}: {_one_line(v) if k == 'WARC-Target-URI' else v}\r\n" for k, v in lines.items() if v is not None)
    return f"WARC/1.1\r\n{head}\r\n".encode() + http + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(record header, HTTP header, body) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return fields, _fields(http), body


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return dict(line.split(": ", 1) for line in lines if ": " in line)


def planned(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """The records to write: ``type, id, url, digest, bytes, body, refers_to, copy``.

    Bodies move once per distinct payload: equal ones meet where their digest is counted, and only the
    response keeps one. Revisits are rows without a body.
    """
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumns({"digest": F.sha2(F.encode("body", "utf-8"), 256), "bytes": F.octet_length("body").cast("long")})
    shared = F.col("bytes") >= LEAST_SHARED
    # Rows in the order in which they may be the response: nulls last, then by id and URL.
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", F.col("url").isNull().alias("no_url"), "url")
    alone = rows.filter(~shared).groupBy("id", "url", "body", "digest", "bytes").agg(F.count("*").alias("n"))
    nobody = F.lit(None).cast(pages.schema[id_col].dataType)
    small = _each(alone).select(F.lit("response").alias("type"), "id", "url", "digest", "bytes", "body", nobody.alias("refers_to"), "copy")
    narrow = cut_lineage(
        rows.filter(shared).groupBy("digest", "bytes", "id", "url").agg(F.count("*").alias("n")).withColumn("place", place)
    )
    firsts = narrow.groupBy("digest").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    several = attach_by_key(narrow, firsts, "digest", "rows")
    again = several.withColumn("n", F.col("n") - F.when(F.col("place").eqNullSafe(F.col("first")), 1).otherwise(0)).filter("n > 0")
    revisits = _each(again).select(
        F.lit("revisit").alias("type"), "id", "url", "digest", "bytes", F.lit("").alias("body"), F.col("first.id").alias("refers_to"), "copy"
    )
    responses = rows.filter(shared).groupBy("digest").agg(F.min(place).alias("first"), F.any_value("bytes").alias("bytes"), F.any_value("body").alias("body"))
    named = responses.select(
        F.lit("response").alias("type"), "first.id", "first.url", "digest", "bytes", "body", nobody.alias("refers_to"), F.lit(1).cast("long").alias("copy")
    )
    return small.unionByName(revisits).unionByName(named)


def _each(counted: DataFrame) -> DataFrame:
    """Every row ``n`` times, numbered by ``copy`` from 1; many copies of one row are dealt out in pieces."""
    one = F.lit(1).cast("long")
    few = counted.filter(F.col("n") <= PIECE).withColumn("copy", F.explode(F.sequence(one, "n")))
    pieces = counted.filter(F.col("n") > PIECE).withColumn("_begin", F.explode(F.sequence(one, "n", F.lit(PIECE).cast("long"))))
    dealt = pieces.repartition("digest", "id", "_begin")
    many = dealt.withColumn("copy", F.explode(F.sequence("_begin", F.least("n", F.col("_begin") + (PIECE - 1))))).drop("_begin")
    return few.unionByName(many)


def write_archives(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Write one record per row and return the index: ``archive, offset, length, url, digest, record_id, type``.

    ``folder`` is one that all executors reach, a path or a URI that pyarrow opens (default: one under the
    shared folder). Of rows with equal payloads of at least 100 bytes the one with the smallest id (then URL; nulls
    last) is a response and the others are revisits that refer to it; of rows that agree in id and URL
    too, one is the response. Shorter payloads are all responses. A null payload is an empty one; a null
    URL gives a record without target, a null id one without ``Page-ID``. Control characters and blanks
    in URLs are percent-encoded in the record; the index keeps the URL as it is. An empty table gives an
    empty index and no archive. Other columns are not read.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")

    def run(batches):
        store, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        out = name = None
        offset, index = 0, []

        def sealed():
            out.close()
            return pa.RecordBatch.from_pylist(index, schema=pa.schema([
                ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()),
                ("digest", pa.string()), ("record_id", pa.string()), ("type", pa.string()),
            ]))

        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"  # another one for every attempt
                    store.create_dir(path, recursive=True)
                    out, offset, index = store.open_output_stream(f"{path}/{name}", compression=None), 0, []
                response = record_id(f"response/{row['digest']}")
                if row["type"] == "revisit":
                    own = record_id(f"revisit/{row['id']!r}/{row['url']!r}/{row['digest']}/{row['copy']}")
                elif row["bytes"] < LEAST_SHARED:
                    own = record_id(f"small/{row['id']!r}/{row['url']!r}/{row['digest']}/{row['copy']}")
                else:
                    own = response
                fields = {
                    "WARC-Target-URI": row["url"], "WARC-Payload-Digest": f"sha256:{row['digest']}", "Page-ID": _quoted(row["id"]),
                    "WARC-Profile": PROFILE if row["type"] == "revisit" else None,
                    "WARC-Refers-To": response if row["type"] == "revisit" else None, "Refers-To-Page-ID": _quoted(row["refers_to"]),
                }
                body = row["body"].encode("utf-8", "surrogatepass")
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = packer.compress(record(row["type"], own, fields, row["bytes"], body)) + packer.flush()
                out.write(data)
                index.append({"archive": name, "offset": offset, "length": len(data), "url": row["url"], "digest": row["digest"], "record_id": own, "type": row["type"]})
                offset += len(data)
                if offset >= archive_bytes:
                    yield sealed()
                    out = None
        if out is not None:
            yield sealed()

    plan = planned(pages, id_col, url_col, payload_col)
    texts = plan.select("type", F.col("id").cast("string").alias("id"), "url", "digest", "bytes", "body", F.col("refers_to").cast("string").alias("refers_to"), "copy")
    index = cut_lineage(texts.mapInArrow(run, INDEX))
    return index.withColumn("archive", F.concat(F.lit(folder.rstrip("/") + "/"), "archive"))


def coalesced(places: Iterator[tuple[str, int, int]], gap: int = GAP_BYTES, most: int = REQUEST_BYTES) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (archive, offset, length) as requests: (archive, offset, length, [(offset, length) of the records])."""
    name, start, end, held = None, 0, 0, []
    for archive, offset, length in places:
        if held and (archive != name or offset > end + gap or offset + length - start > most):
            yield name, start, end - start, held
            held = []
        if not held:
            name, start, end = archive, offset, offset
        end = max(end, offset + length)
        held.append((offset, length))
    if held:
        yield name, start, end - start, held


def read_records(index: DataFrame, gap: int = GAP_BYTES, most: int = REQUEST_BYTES, bodies: bool = True) -> DataFrame:
    """The records that the rows of ``index`` name: ``record_id, type, page_id, url, bytes, digest, refers_to, refers_to_page, body``.

    ``bytes`` and ``digest`` are those of the full payload: counted on the body of a response, which must
    agree with its header, and taken from the header of a revisit. ``body`` is null for revisits, and for
    all without ``bodies``. Ids are text, as the records have them.
    """
    schema = "record_id string, type string, page_id string, url string, bytes long, digest string, refers_to string, refers_to_page string, body string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        store = name = opened = None
        for batch in batches:
            places = zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")))
            for archive, start, length, records in coalesced(places, gap, most):
                if archive != name:
                    if opened is not None:
                        opened.close()
                    store, path = fs.FileSystem.from_uri(archive if "://" in archive else f"file://{archive}")
                    name, opened = archive, store.open_input_file(path)
                data = opened.read_at(length, start)
                out = []
                for offset, size in records:
                    fields, http, body = parse(zlib.decompress(data[offset - start : offset - start + size], 31))
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    count = int(http["Content-Length"])
                    if kind == "response" and (len(body) != count or hashlib.sha256(body).hexdigest() != digest):
                        raise ValueError(f"damaged record {fields['WARC-Record-ID']} in {archive}")
                    text = body.decode("utf-8", "surrogatepass") if bodies and kind == "response" else None
                    out.append((
                        fields["WARC-Record-ID"], kind, _unquoted(fields.get("Page-ID")), fields.get("WARC-Target-URI"), count, digest,
                        fields.get("WARC-Refers-To"), _unquoted(fields.get("Refers-To-Page-ID")), text,
                    ))
                kinds = [pa.int64() if c == "bytes" else pa.string() for c in names]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names=names)
        if opened is not None:
            opened.close()

    order = ["archive", "offset"]
    ranged = index.select("archive", "offset", "length").repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.mapInArrow(run, schema)


def resolve(index: DataFrame, records: DataFrame) -> DataFrame:
    """``records`` with the body of a revisit filled in from the response it refers to, read through the index."""
    wanted = records.filter("type = 'revisit'").groupBy("refers_to").agg(F.count("*").alias("rows"))
    named = index.join(wanted, index.record_id == wanted.refers_to, "left_semi")
    bodies = read_records(named).select(F.col("record_id").alias("refers_to"), F.col("body").alias("found"))
    filled = attach_by_key(records.drop("rows"), bodies.join(wanted, "refers_to"), "refers_to", "rows")
    return filled.withColumn("body", F.coalesce("body", "found")).drop("found")
