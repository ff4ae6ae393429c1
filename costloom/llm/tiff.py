"""Media columns holding TIFF: walk the image directories, decode strips or tiles, one row per page.

Decodes uncompressed, PackBits, LZW (both bit orders) and deflate data, undoes horizontal (2) and floating-point
(3) predictors, reads either byte order and fill order, chunky and planar samples of whole bytes and of
1, 2 or 4 bits (given as a byte each). Each file is decoded inside
one task, so memory is one file's; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costloom.llm.common import emit, sliced, whole_text

# Fixed values of the TIFF 6.0 format: field types to (size, struct letter); tags; compression schemes.
FIELD = {1: (1, "B"), 2: (1, "B"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i")}
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_AT, TILE_BYTES, FILL_ORDER = 322, 323, 324, 325, 266
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946


class TiffError(ValueError):
    """The bytes aren't a TIFF file that can be decoded."""


def pack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    for m in re.finditer(rb"(.)\1{2,127}", data, re.DOTALL):
        for i in range(at, m.start(), 128):
            part = data[i : min(i + 128, m.start())]
            out.append(len(part) - 1)
            out += part
        out += bytes((257 - (m.end() - m.start()), data[m.start()]))
        at = m.end()
    for i in range(at, len(data), 128):
        out.append(len(data[i : i + 128]) - 1)
        out += data[i : i + 128]
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    """Most significant bit first; codes widen one entry early, as the format has it.

    An entry is keyed by the code of its run and the byte after it, so no run is copied.
    """
    clear, stop = 256, 257
    table: dict[int, int] = {}
    nxt, width, out = 258, 9, bytearray()
    acc, held = clear, 9
    run = -1
    for byte in data:
        if run < 0:
            run = byte
            continue
        key = run << 8 | byte
        found = table.get(key)
        if found is not None:
            run = found
            continue
        acc, held = acc << width | run, held + width
        table[key] = nxt
        nxt += 1
        if nxt == 1 << width and width < 12:
            width += 1
        if nxt == 4094:
            acc, held = acc << width | clear, held + width
            table.clear()
            nxt, width = 258, 9
        if held >= 256:
            held -= 256
            out += (acc >> held).to_bytes(32, "big")
            acc &= (1 << held) - 1
        run = byte
    if run >= 0:
        acc, held = acc << width | run, held + width
        nxt += 1
        if nxt == 1 << width and width < 12:
            width += 1
    acc, held = acc << width | stop, held + width
    spare = -held % 8
    out += (acc << spare).to_bytes((held + spare) // 8, "big")
    return bytes(out)


def _codes_low_first(data: bytes) -> Iterator[int]:
    """Codes of the oldest files: least significant bit first, one code later to widen."""
    acc = held = 0
    width, free = 9, 258
    for byte in data:
        acc, held = acc | byte << held, held + 8
        if held < width:
            continue
        code = acc & (1 << width) - 1
        acc, held = acc >> width, held - width
        yield code
        if code == 256:
            width, free = 9, 257  # the first code after it adds nothing
        elif free < 4096:
            free += 1
            if free == 1 << width and width < 12:
                width += 1


def _codes_high_first(data: bytes) -> Iterator[int]:
    """Codes as TIFF 6.0 has them: most significant bit first, one code early to widen."""
    acc = held = 0
    width, free = 9, 258
    for byte in data:
        acc, held = acc << 8 | byte, held + 8
        if held < width:
            continue
        held -= width
        code = acc >> held
        acc &= (1 << held) - 1
        yield code
        if code == 256:
            width, free = 9, 257
        elif free < 4096:
            free += 1
            if free == (1 << width) - 1 and width < 12:
                width += 1


_LITERALS = [bytes((i,)) for i in range(256)] + [b"", b""]


def lzw_decode(data: bytes, size: int) -> bytes:
    table, last, out = list(_LITERALS), None, bytearray()
    old = data[:1] == b"\0" and len(data) > 1 and data[1] & 1  # a clear code, written low bits first
    for code in _codes_low_first(data) if old else _codes_high_first(data):
        if code == 257:
            break
        if code == 256:
            table, last = list(_LITERALS), None
            continue
        if last is None:
            if code > 255:
                raise TiffError("LZW: no literal after clear")
            found = table[code]
        elif code < len(table):
            found = table[code]
            table.append(last + found[:1])
        elif code == len(table):
            found = last + last[:1]
            table.append(found)
        else:
            raise TiffError("LZW: code out of range")
        out += found
        last = found
        if len(out) >= size:
            break
    return bytes(out[:size])


def _unpack(kind: int, data: bytes, size: int) -> bytes:
    if kind == NONE:
        return data[:size]
    if kind == PACKBITS:
        return unpack_bits(data, size)
    if kind == LZW:
        return lzw_decode(data, size)
    if kind in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from None
    raise TiffError(f"compression {kind}")


def _undo(predictor: int, block: np.ndarray, order: str, width: int) -> np.ndarray:
    """block: rows x pixels x samples x bytes of a sample."""
    rows, pixels, samples, size = block.shape
    if predictor == 1:
        return block
    if predictor == 2:
        kind = np.dtype(f"{order}u{size}")
        values = np.ascontiguousarray(block).view(kind)[..., 0]
        return np.cumsum(values, axis=1, dtype=kind.newbyteorder("=")).astype(kind)[..., None].view(np.uint8).reshape(block.shape)
    if predictor == 3:
        # Bytes are grouped by significance along the row, then differenced byte by byte.
        flat = block.reshape(rows, -1, samples) if samples > 1 else block.reshape(rows, -1, 1)
        flat = np.cumsum(flat, axis=1, dtype=np.uint8).reshape(rows, size, pixels * samples)
        flat = flat.transpose(0, 2, 1)
        return (flat if order == ">" else flat[..., ::-1]).reshape(block.shape)
    raise TiffError(f"predictor {predictor}")


def walk(data: bytes) -> Iterator[dict]:
    """The image directories of a file: tag -> list of values, with the byte order under "order"."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise TiffError("no TIFF header")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at:
        if at in seen or at + 2 > len(data):
            raise TiffError("directory chain is broken")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        if at + 2 + 12 * n + 4 > len(data):
            raise TiffError("directory is cut off")
        tags: dict = {"order": order}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind not in FIELD:
                continue
            size, letter = FIELD[kind]
            place = at + 10 + 12 * i
            if size * count > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            if place + size * count > len(data):
                raise TiffError(f"tag {tag} is cut off")
            tags[tag] = list(struct.unpack_from(f"{order}{count}{letter}", data, place))
        yield tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


_TURNED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_samples(data: bytes, tags: dict) -> dict:
    """One page: its geometry and its samples as bytes, row by row."""
    one = lambda tag, default=None: tags.get(tag, [default])[0]
    width, height, spp = one(WIDTH), one(LENGTH), one(SAMPLES, 1)
    bits = tags.get(BITS, [1])
    if not width or not height:
        raise TiffError("page without size")
    if len(set(bits)) != 1 or bits[0] not in (1, 2, 4) and bits[0] % 8 or not 0 < bits[0] <= 64:
        raise TiffError(f"samples of {bits} bits")
    size, kind, predictor = -(-bits[0] // 8), one(COMPRESSION, 1), one(PREDICTOR, 1)
    if bits[0] < 8 and predictor != 1:
        raise TiffError(f"predictor {predictor} over {bits[0]} bits")
    tiled, planes = TILE_AT in tags, spp if one(PLANAR, 1) == 2 else 1
    if tiled:
        bw, bh, places, counts = one(TILE_WIDTH), one(TILE_LENGTH), tags[TILE_AT], tags.get(TILE_BYTES, [])
    else:
        bw, bh, places, counts = width, min(one(ROWS_PER_STRIP, height) or height, height), tags.get(STRIP_AT, []), tags.get(STRIP_BYTES, [])
    if not bw or not bh or not places:
        raise TiffError("page without data")
    across, down, chunk = -(-width // bw), -(-height // bh), spp // planes
    if not counts:  # some writers leave them out: each goes on to the next, or to the end
        ends = sorted(set(places) | {len(data)})
        counts = [next((e for e in ends if e > at), at) - at for at in places]
    if len(places) < across * down * planes or len(counts) < len(places):
        raise TiffError("strips or tiles are missing")
    out = np.zeros((height, width, spp, size), np.uint8)
    for plane in range(planes):
        for j in range(down):
            for i in range(across):
                k = (plane * down + j) * across + i
                rows = bh if tiled else min(bh, height - j * bh)
                line = -(-bw * chunk * bits[0] // 8)  # a row begins at a whole byte
                part = data[places[k] : places[k] + counts[k]]
                raw = _unpack(kind, part.translate(_TURNED) if one(FILL_ORDER, 1) == 2 else part, rows * line)
                if len(raw) < rows * line:
                    raise TiffError("strip or tile is too short")
                block = np.frombuffer(raw, np.uint8)
                if bits[0] < 8:
                    single = np.unpackbits(block.reshape(rows, line), axis=1).reshape(rows, -1, bits[0])
                    block = np.packbits(np.pad(single, ((0, 0), (0, 0), (8 - bits[0], 0))), axis=2)[:, : bw * chunk, 0]
                block = _undo(predictor, block.reshape(rows, bw, chunk, size), tags["order"], bw)
                part = block[: height - j * bh, : width - i * bw]
                out[j * bh : j * bh + part.shape[0], i * bw : i * bw + part.shape[1], plane * chunk : plane * chunk + chunk] = part
    return {"width": width, "height": height, "samples_per_pixel": spp, "bits": bits[0], "compression": kind, "predictor": predictor, "tiled": tiled, "samples": out.tobytes()}


def write_tiff(pages: list[dict], order: str = "<") -> bytes:
    """A file of 8-bit pages: each has width, data, compression, predictor, rows (of a strip) or tile (its side)."""
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    pack = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: pack_bits}
    for page in pages:
        spp, width = page.get("samples_per_pixel", 1), page["width"]
        image = np.frombuffer(page["data"], np.uint8).reshape(-1, width, spp)
        height, tile = len(image), page.get("tile")
        bw, bh = (tile, tile) if tile else (width, page.get("rows", 128))
        places, counts = [], []
        for y in range(0, height, bh):
            for x in range(0, width, bw):
                block = image[y : y + bh, x : x + bw]
                if tile:
                    block = np.pad(block, ((0, bh - block.shape[0]), (0, bw - block.shape[1]), (0, 0)))
                if page.get("predictor", 1) == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros((len(block), 1, spp), np.uint8))
                raw = pack[page["compression"]](block.tobytes())
                places.append(len(out))
                counts.append(len(raw))
                out += raw + b"\0" * (len(raw) % 2)
        tags = {WIDTH: [width], LENGTH: [height], BITS: [8] * spp, COMPRESSION: [page["compression"]], PHOTOMETRIC: [1 if spp == 1 else 2], SAMPLES: [spp], PREDICTOR: [page.get("predictor", 1)]}
        tags |= {TILE_WIDTH: [bw], TILE_LENGTH: [bh], TILE_AT: places, TILE_BYTES: counts} if tile else {STRIP_AT: places, ROWS_PER_STRIP: [bh], STRIP_BYTES: counts}
        entries = b""
        for tag in sorted(tags):
            raw = struct.pack(f"{order}{len(tags[tag])}I", *tags[tag])
            if len(raw) > 4:
                raw, at = struct.pack(order + "I", len(out)), raw
                out += at
            entries += struct.pack(order + "HHI", tag, 4, len(tags[tag])) + raw
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


PAGE = "page int, width int, height int, samples_per_pixel int, bits int, compression int, predictor int, tiled boolean, samples binary, error string"
_PAGE = [("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples_per_pixel", pa.int32()), ("bits", pa.int32()), ("compression", pa.int32()), ("predictor", pa.int32()), ("tiled", pa.bool_()), ("samples", pa.binary()), ("error", pa.string())]


def decoded(data: bytes | None) -> Iterator[dict]:
    """The pages of a file in order; a file that can't be read on gives a last row with error."""
    page = 0
    try:
        for tags in walk(data or b""):
            yield {"page": page, **page_samples(data, tags)}
            page += 1
    except (TiffError, struct.error, ValueError, MemoryError, OverflowError) as e:
        yield {"page": page, "error": str(e)[:200] or type(e).__name__}
        return
    if not page:
        yield {"page": 0, "error": "no directory"}


def tiff_pages(df: DataFrame, id_col: str = "doc_id", media: str = "media", keep: tuple = ()) -> DataFrame:
    """One row per page of each file: id_col, the columns of keep, media_bytes, media_sha256 and the page's.

    Null or empty media, bytes that aren't TIFF and damaged files give a row with error and no samples
    after the pages that could be read. Rows keep the order of their file; repeated files are decoded
    each; extra columns are ignored; an empty table gives no rows.
    """
    own = [id_col, *keep]
    kinds = ", ".join(f"own_{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(own))
    narrow = df.select(*[F.col(c).alias(f"own_{i}") for i, c in enumerate(own)], F.col(media).alias("media"))

    def pages(batches):
        schema = None
        for batch in sliced(batches):
            if schema is None:
                schema = pa.schema([*list(batch.schema)[:-1], ("media_bytes", pa.int64()), ("media_sha256", pa.string()), *_PAGE])
                rows = emit(schema)
            for head, data in zip(batch.select(batch.schema.names[:-1]).to_pylist(), batch["media"].to_pylist(), strict=True):
                head |= {"media_bytes": len(data or b""), "media_sha256": hashlib.sha256(data or b"").hexdigest()}
                for page in decoded(data):
                    yield from rows.add(head | page, 200 + len(page.get("samples", b"")))
        if schema is not None:
            yield from rows.rest()

    out = narrow.mapInArrow(pages, f"{kinds}, media_bytes long, media_sha256 string, {PAGE}")
    return out.withColumnsRenamed({f"own_{i}": c for i, c in enumerate(own)})


#: How op1 stores payloads, in turn by a hash of the payload, whatever its size: compression, predictor, tile side or None for strips.
LAYOUTS = tuple((kind, predictor, tile) for kind in (LZW, PACKBITS, DEFLATE) for predictor in (1, 2) for tile in (None, 32))
#: Samples of one page at most; a longer payload has more pages.
PAGE_SAMPLES = 1 << 20


def text_as_tiff(text: str) -> bytes:
    """The text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as grey pages 64 wide."""
    payload = text.encode()
    payload += b"\0" * (-len(payload) % 64 or (0 if payload else 64))
    kind, predictor, tile = LAYOUTS[zlib.crc32(payload) % len(LAYOUTS)]
    return write_tiff([{"width": 64, "data": payload[i : i + PAGE_SAMPLES], "compression": kind, "predictor": predictor, "tile": tile} for i in range(0, len(payload), PAGE_SAMPLES)])


def stored_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text as a TIFF file; null is the empty text."""

    def store(batches):
        rows = emit(pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())]))
        for batch in sliced(batches):
            for key, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                data = text_as_tiff(text)
                yield from rows.add({"doc_id": key, "n_bytes": len(text.encode()), "media": data}, 64 + len(data))
        yield from rows.rest()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(store, "doc_id long, n_bytes long, media binary")


def payload_features(docs: DataFrame) -> DataFrame:
    """Stores the texts as TIFF, reads the pages back by tiff_pages and describes each document's payload.

    n_bytes is the text's length in UTF-8 before the padding. Equal texts give equal values in every column;
    null is the empty text, repeated rows give a row each, no rows none, extra columns are ignored.
    """
    pages = tiff_pages(stored_texts(docs), keep=("n_bytes",))

    def digest(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("pages", pa.int32())])
        rows, held = emit(schema), None

        def done(x):
            counts = x["counts"]
            share = counts[counts > 0] / max(1, x["n"])
            feature = f"pages={x['pages']};width={x['width']};rows={x['rows']};zeros={counts[0]};distinct={len(share)};sum={int((counts * np.arange(256)).sum())};entropy={-(share * np.log2(share)).sum():.6f}"
            return {"doc_id": x["doc_id"], "n_bytes": x["n_bytes"], "payload_bytes": x["n"], "payload_sha256": x["sha"].hexdigest(), "tail_crc32": zlib.crc32(x["tail"]), "media_bytes": x["media_bytes"], "media_sha256": x["media_sha256"], "feature": feature, "pages": x["pages"]}

        for batch in sliced(batches):
            for r in batch.to_pylist():
                if r["error"]:
                    raise TiffError(r["error"])
                if r["page"] == 0:  # a document's pages follow each other in its partition
                    if held:
                        yield from rows.add(done(held), 400)
                    held = {"doc_id": r["doc_id"], "n_bytes": r["n_bytes"], "n": 0, "sha": hashlib.sha256(), "tail": b"", "counts": np.zeros(256, np.int64), "pages": 0, "rows": 0, "width": r["width"], "media_bytes": r["media_bytes"], "media_sha256": r["media_sha256"]}
                data = r["samples"]
                held["n"] += len(data)
                held["sha"].update(data)
                held["tail"] = (held["tail"] + data[-64:])[-64:]
                held["counts"] += np.bincount(np.frombuffer(data, np.uint8), minlength=256)
                held["pages"] += 1
                held["rows"] += r["height"]
        if held:
            yield from rows.add(done(held), 400)
        yield from rows.rest()

    return pages.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "page", "width", "height", "samples", "error").mapInArrow(digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages int")


def op1_tiff(spark, sf_dir: str) -> DataFrame:
    return payload_features(spark.read.parquet(f"{sf_dir}/documents.parquet"))
