"""Tags, stream properties and pictures of FLAC, MP3, WAV and Ogg Vorbis files, read and written as bytes.

The reader takes a seekable source and reads headers and tag blocks only, at most ``MOST`` bytes of any one: audio and
picture data are stepped over.  The writer gives a file's new content: it keeps what it does not set, puts a
smaller tag into the room of the old one, so that audio stays where it is, and else leaves ``PADDING`` free bytes.

FLAC takes Vorbis comments, MP3 an ID3v2.3 tag at its head, WAV the same tag in an ``id3 `` chunk.  ID3v2.2 to 2.4
are read.  Ogg files are read only: a tag of another format would break them.
"""

from __future__ import annotations

import io
import os
import struct
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

MOST, PADDING = 1 << 24, 1024
# fixed values: tag names of ID3v2.3, of ID3v2.2, of user frames by description, and of RIFF INFO
FRAMES = {"TPE1": "artist", "TIT2": "title", "TALB": "album", "TPE2": "albumartist", "TRCK": "tracknumber", "TCON": "genre", "TBPM": "bpm", "TSRC": "isrc", "TDRC": "date", "TYER": "year"}
OLD_FRAMES = {"TP1": "TPE1", "TT2": "TIT2", "TAL": "TALB", "TP2": "TPE2", "TRK": "TRCK", "TCO": "TCON", "TBP": "TBPM", "TYE": "TYER", "TXX": "TXXX", "PIC": "APIC"}
USER_FRAMES = {"MusicBrainz Track Id": "musicbrainz_trackid", "MusicBrainz Album Id": "musicbrainz_albumid", "REPLAYGAIN_TRACK_GAIN": "replaygain_track_gain", "REPLAYGAIN_TRACK_PEAK": "replaygain_track_peak"}
INFO = {"IART": "artist", "INAM": "title", "IPRD": "album", "ICRD": "date", "IGNR": "genre", "ITRK": "tracknumber"}
# fixed values: kbit/s of MPEG 1 and of MPEG 2 and 2.5, layer III, and Hz of MPEG 1
MPEG1_RATES = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
MPEG2_RATES = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
MPEG_HZ = (44100, 48000, 32000)
ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")


class TagError(ValueError):
    """A file that is not what its head says, or of no known kind."""


def _take(f, n: int) -> bytes:
    if n > MOST:
        raise TagError(f"a block of {n} bytes")
    got = f.read(n)
    if len(got) < n:
        raise TagError("the file ends within a block")
    return got


def _safe(b: bytes) -> int:
    """A synchsafe number: seven bits a byte."""
    if any(x & 0x80 for x in b):
        raise TagError("a size that is not synchsafe")
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _to_safe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def read(f) -> dict:
    """tags (name to list of values), sample_rate, channels, bits, bitrate and pictures (mime, kind, description, size) of an open file."""
    size = f.seek(0, io.SEEK_END)
    f.seek(0)
    out = {"tags": {}, "sample_rate": None, "channels": None, "bits": None, "bitrate": None, "pictures": []}
    if size == 0:
        raise TagError("an empty file")
    at = 0
    if f.read(3) == b"ID3":
        at = _read_id3(f, 0, out)
    f.seek(at)
    head = f.read(4)
    if head == b"fLaC":
        _read_flac(f, size, out)
    elif head == b"RIFF":
        _read_riff(f, at, out)
    elif head == b"OggS":
        _read_ogg(f, at, out)
    elif at or len(head) == 4 and head[0] == 0xFF and head[1] & 0xE0 == 0xE0:
        _read_mpeg(f, at, out)
    else:
        raise TagError("unknown kind of file")
    return out


def _add(out: dict, name: str, value: str) -> None:
    if value:
        out["tags"].setdefault(name.lower(), []).append(value)


def _frames(data: bytes, version: int) -> Iterator[tuple[str, bytes]]:
    """(identifier in its v2.3 form, body) of each frame."""
    at, old = 0, version == 2
    while at + (6 if old else 10) <= len(data) and data[at]:
        name = data[at : at + (3 if old else 4)].decode("latin-1")
        if old:
            n, flags, at = int.from_bytes(data[at + 3 : at + 6], "big"), 0, at + 6
        else:
            raw = data[at + 4 : at + 8]
            n, flags, at = _safe(raw) if version == 4 else int.from_bytes(raw, "big"), data[at + 9], at + 10
        if at + n > len(data):
            raise TagError(f"frame {name} is cut off")
        body, at = data[at : at + n], at + n
        if version == 4 and flags & 1:  # with the length before unsynchronisation
            body = body[4:]
        if version == 4 and flags & 2:
            body = body.replace(b"\xff\x00", b"\xff")
        if not flags & (0x0C if version == 4 else 0xC0):  # neither packed nor encrypted
            yield OLD_FRAMES.get(name, name), body


def _split(data: bytes, encoding: int) -> tuple[bytes, bytes]:
    """Up to the terminator of the encoding, and after it."""
    step = 2 if encoding in (1, 2) else 1
    for i in range(0, len(data) - step + 1, step):
        if not any(data[i : i + step]):
            return data[:i], data[i + step :]
    return data, b""


def _texts(data: bytes, encoding: int) -> list[str]:
    if encoding >= len(ENCODINGS):
        raise TagError(f"text encoding {encoding}")
    out = []
    while data:
        one, data = _split(data, encoding)
        out.append(one.decode(ENCODINGS[encoding], "replace"))
    return out


def _read_id3(f, at: int, out: dict) -> int:
    """Reads the tag at a place and gives where it ends."""
    f.seek(at)
    head = _take(f, 10)
    version, flags, n = head[3], head[5], _safe(head[6:10])
    if version not in (2, 3, 4):
        raise TagError(f"ID3v2.{version}")
    data = _take(f, n)
    if flags & 0x80 and version < 4:
        data = data.replace(b"\xff\x00", b"\xff")
    if flags & 0x40 and version > 2:
        data = data[_safe(data[:4]) if version == 4 else 4 + int.from_bytes(data[:4], "big") :]
    parts: dict[str, str] = {}
    for name, body in _frames(data, version):
        if not body:
            continue
        if name == "TXXX":
            description, *values = _texts(body[1:], body[0]) or [""]
            for v in values:
                _add(out, USER_FRAMES.get(description, description), v)
        elif name == "APIC":
            mime, rest = (body[1:4], body[4:]) if version == 2 else _split(body[1:], 0)
            description, data_ = _split(rest[1:], body[0])
            out["pictures"].append({"mime": mime.decode("latin-1"), "kind": rest[0], "description": description.decode(ENCODINGS[body[0]], "replace"), "size": len(data_)})
        elif name == "TDAT":
            parts["day"] = "".join(_texts(body[1:], body[0])[:1])
        elif name in FRAMES:
            for v in _texts(body[1:], body[0]):
                _add(out, FRAMES[name], v)
    year, day = out["tags"].get("year", [""])[0], parts.get("day", "")
    if year and "date" not in out["tags"]:
        out["tags"]["date"] = [f"{year}-{day[2:4]}-{day[:2]}" if len(day) == 4 else year]
    return at + 10 + n + (10 if flags & 0x10 and version == 4 else 0)


def _flac_blocks(f) -> Iterator[tuple[int, int, int]]:
    """(kind, place of the body, size) of the metadata blocks behind the marker."""
    last = False
    while not last:
        head = _take(f, 4)
        last, kind, n = bool(head[0] & 0x80), head[0] & 0x7F, int.from_bytes(head[1:], "big")
        at = f.tell()
        yield kind, at, n
        f.seek(at + n)


def _read_flac(f, size: int, out: dict) -> None:
    samples = 0
    for kind, _, n in _flac_blocks(f):
        if kind == 0:
            packed = int.from_bytes(_take(f, 34)[10:18], "big")
            out["sample_rate"], out["channels"], out["bits"], samples = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
            if not out["sample_rate"]:
                raise TagError("a sample rate of 0")
        elif kind == 4:
            _read_comments(_take(f, n), out)
        elif kind == 6:
            kind_, m = struct.unpack(">II", _take(f, 8))
            mime = _take(f, m).decode("latin-1")
            (m,) = struct.unpack(">I", _take(f, 4))
            description = _take(f, m).decode("utf-8", "replace")
            out["pictures"].append({"mime": mime, "kind": kind_, "description": description, "size": struct.unpack(">5I", _take(f, 20))[4]})
    if out["sample_rate"] is None:
        raise TagError("no stream information")
    if samples:
        out["bitrate"] = (size - f.tell()) * 8 * out["sample_rate"] // samples


def _read_comments(data: bytes, out: dict) -> None:
    try:
        (n,) = struct.unpack_from("<I", data)
        at = 4 + n
        (count,) = struct.unpack_from("<I", data, at)
        at += 4
        for _ in range(count):
            (n,) = struct.unpack_from("<I", data, at)
            if at + 4 + n > len(data):
                raise TagError("a comment is cut off")
            name, _, value = data[at + 4 : at + 4 + n].decode("utf-8", "replace").partition("=")
            _add(out, name, value)
            at += 4 + n
    except struct.error:
        raise TagError("comments are cut off") from None


def _read_riff(f, at: int, out: dict) -> None:
    f.seek(at)
    if _take(f, 12)[8:] != b"WAVE":
        raise TagError("a RIFF file that is no WAVE")
    while len(head := f.read(8)) == 8:
        name, n, at = head[:4], int.from_bytes(head[4:], "little"), f.tell()
        if name == b"fmt ":
            _, out["channels"], out["sample_rate"], rate, _, out["bits"] = struct.unpack("<HHIIHH", _take(f, 16))
            out["bitrate"] = rate * 8
        elif name in (b"id3 ", b"ID3 "):
            _read_id3(f, at, out)
        elif name == b"LIST" and n >= 4 and f.read(4) == b"INFO":
            data, i = _take(f, n - 4), 0
            while i + 8 <= len(data):
                m = int.from_bytes(data[i + 4 : i + 8], "little")
                if (key := INFO.get(data[i : i + 4].decode("latin-1"))) and key not in out["tags"]:
                    _add(out, key, data[i + 8 : i + 8 + m].rstrip(b"\0").decode("utf-8", "replace"))
                i += 8 + m + m % 2
        f.seek(at + n + n % 2)
    if out["sample_rate"] is None:
        raise TagError("no fmt chunk")


def _read_ogg(f, at: int, out: dict) -> None:
    """The first two packets: identification and comments."""
    f.seek(at)
    packets, open_ = [], b""
    while len(packets) < 2:
        head = _take(f, 27)
        if head[:4] != b"OggS":
            raise TagError("a page is missing")
        sizes = _take(f, head[26])
        for n in sizes:
            open_ += _take(f, n)
            if len(open_) > MOST:
                raise TagError("a packet without end")
            if n < 255:
                packets.append(open_)
                open_ = b""
    if packets[0][:7] != b"\x01vorbis" or packets[1][:7] != b"\x03vorbis" or len(packets[0]) < 28:
        raise TagError("an Ogg stream that is no Vorbis")
    out["channels"], out["sample_rate"] = packets[0][11], int.from_bytes(packets[0][12:16], "little")
    out["bitrate"] = int.from_bytes(packets[0][20:24], "little") or None
    _read_comments(packets[1][7:], out)


def _read_mpeg(f, at: int, out: dict) -> None:
    """The first frame header within 64 KB of the place."""
    f.seek(at)
    data = f.read(1 << 16)
    for i in range(len(data) - 3):
        if data[i] == 0xFF and data[i + 1] & 0xE6 == 0xE2:  # layer III
            version, rate, hz = data[i + 1] >> 3 & 3, data[i + 2] >> 4, data[i + 2] >> 2 & 3
            if version != 1 and rate < 15 and hz < 3:
                out["sample_rate"] = MPEG_HZ[hz] >> {3: 0, 2: 1, 0: 2}[version]
                out["bitrate"] = (MPEG1_RATES if version == 3 else MPEG2_RATES)[rate] * 1000 or None
                out["channels"] = 1 if data[i + 3] >> 6 == 3 else 2
                return
    raise TagError("no audio frame")


def write(content: bytes, tags: dict[str, str], picture: tuple[str, bytes] | None = None) -> bytes:
    """The content with these tags set, and with the picture (mime, bytes) as its only front cover if there is one."""
    at = 0
    if content[:3] == b"ID3":
        at = 10 + _safe(content[6:10])
    if content[at : at + 4] == b"fLaC":
        return content[:at] + _write_flac(content[at:], tags, picture)
    if content[:4] == b"RIFF":
        return _write_riff(content, tags, picture)
    if content[at : at + 4] in (b"OggS", b"RIFF") or content[4:8] == b"ftyp" or not content:
        raise TagError("tags cannot be written into this kind of file")
    old = content[:at]
    return _id3(old, tags, picture, len(old)) + content[at:]


def _write_flac(content: bytes, tags: dict[str, str], picture: tuple[str, bytes] | None) -> bytes:
    f = io.BytesIO(content)
    f.seek(4)
    kept, old, vendor = [], [], b"cadenza"
    for kind, at, n in _flac_blocks(f):
        body = content[at : at + n]
        if kind == 4:
            (m,) = struct.unpack_from("<I", body)
            vendor, at = body[4 : 4 + m], 8 + m
            for _ in range(struct.unpack_from("<I", body, 4 + m)[0]):
                (m,) = struct.unpack_from("<I", body, at)
                old.append(body[at + 4 : at + 4 + m])
                at += 4 + m
        elif kind != 1 and not (kind == 6 and picture):
            kept.append((kind, body))
    audio = f.tell()
    names = {k.upper() for k in tags}
    lines = [x for x in old if x.partition(b"=")[0].decode("utf-8", "replace").upper() not in names] + [f"{k.upper()}={v}".encode() for k, v in tags.items()]
    blocks = [*kept, (4, struct.pack("<I", len(vendor)) + vendor + struct.pack("<I", len(lines)) + b"".join(struct.pack("<I", len(x)) + x for x in lines))]
    if picture:
        mime, data = picture[0].encode(), picture[1]
        blocks.append((6, struct.pack(">II", 3, len(mime)) + mime + struct.pack(">I", 5) + b"Cover" + struct.pack(">5I", 0, 0, 0, 0, len(data)) + data))
    room = audio - 4 - sum(4 + len(b) for _, b in blocks) - 4
    blocks.append((1, bytes(room if room >= 0 else PADDING)))
    if max(len(b) for _, b in blocks) >= 1 << 24:
        raise TagError("a block of 16 MB or more")
    parts = [bytes([kind | (0x80 if i == len(blocks) - 1 else 0)]) + len(b).to_bytes(3, "big") + b for i, (kind, b) in enumerate(blocks)]
    return b"fLaC" + b"".join(parts) + content[audio:]


def _text_frame(name: str, *texts: str) -> bytes:
    body = b"\x01" + b"\0\0".join(t.encode("utf-16") for t in texts)
    return name.encode() + struct.pack(">IH", len(body), 0) + body


def _id3(old: bytes, tags: dict[str, str], picture: tuple[str, bytes] | None, room: int) -> bytes:
    """A version 2.3 tag; frames of an old one that it does not set are kept."""
    names = {v: k for k, v in FRAMES.items() if k not in ("TDRC", "TYER")}
    users = {v: k for k, v in USER_FRAMES.items()}
    new, gone = [], set()
    for key, value in tags.items():
        if key == "date":
            gone |= {"TDRC", "TYER", "TDAT"}
            new.append(_text_frame("TYER", value[:4]))
            if len(value) == 10:
                new.append(_text_frame("TDAT", value[8:10] + value[5:7]))
        elif key in names:
            gone.add(names[key])
            new.append(_text_frame(names[key], value))
        else:
            gone.add(f"TXXX:{key}")
            new.append(_text_frame("TXXX", users.get(key, key), value))
    if picture:
        gone.add("APIC")
        body = b"\x00" + picture[0].encode("latin-1") + b"\0\x03Cover\0" + picture[1]
        new.append(b"APIC" + struct.pack(">IH", len(body), 0) + body)
    kept = []
    if old:
        version, flags, data = old[3], old[5], old[10:]
        if flags & 0x80 and version < 4:
            data = data.replace(b"\xff\x00", b"\xff")
        if flags & 0x40 and version > 2:
            data = data[_safe(data[:4]) if version == 4 else 4 + int.from_bytes(data[:4], "big") :]
        for name, body in _frames(data, version):
            description = (_texts(body[1:], body[0]) or [""])[0] if name == "TXXX" and body else ""
            name_ = f"TXXX:{USER_FRAMES.get(description, description)}" if name == "TXXX" else name
            if len(name) != 4 or name_ in gone or version == 2 and name == "APIC":
                continue
            if name[0] == "T" and body and body[0] in (2, 3):  # encodings that version 2.3 lacks
                body = b"\x01" + b"\0\0".join(t.encode("utf-16") for t in _texts(body[1:], body[0]))
            kept.append(name.encode("latin-1") + struct.pack(">IH", len(body), 0) + body)
    data = b"".join(kept + new)
    n = room - 10 if room - 10 >= len(data) else len(data) + PADDING
    return b"ID3\x03\0\0" + _to_safe(n) + data + bytes(n - len(data))


def _write_riff(content: bytes, tags: dict[str, str], picture: tuple[str, bytes] | None) -> bytes:
    at, chunks, old = 12, [], b""
    while at + 8 <= len(content):
        n = int.from_bytes(content[at + 4 : at + 8], "little")
        body = content[at + 8 : at + 8 + n]
        if content[at : at + 4] in (b"id3 ", b"ID3 "):
            old = body
        else:
            chunks.append((content[at : at + 4], body))
        at += 8 + n + n % 2
    new = _id3(old, tags, picture, len(old))
    parts = [name + len(b).to_bytes(4, "little") + b + bytes(len(b) % 2) for name, b in [*chunks, (b"id3 ", new)]]
    size = 4 + sum(map(len, parts))
    if size >= 1 << 32:
        raise TagError("a RIFF file of 4 GB or more")
    return b"RIFF" + size.to_bytes(4, "little") + b"WAVE" + b"".join(parts)


def rewrite(path: str, tags: dict[str, str], picture: tuple[str, bytes] | None = None) -> None:
    """The same in place: the new content takes the file's name at once."""
    with open(path, "rb") as f:
        new = write(f.read(), tags, picture)
    part = f"{path}.part"
    with open(part, "wb") as f:
        f.write(new)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


_READ = "tags map<string,array<string>>, sample_rate int, channels int, bits int, bitrate int, pictures array<struct<mime:string,kind:int,description:string,size:bigint>>, read_error string"


def read_tags(files: DataFrame) -> DataFrame:
    """path, tags, sample_rate, channels, bits, bitrate, pictures and read_error of files: (path, content) rows, or (path) of files that the executors can open.

    A file that cannot be read has nulls and a message; null paths and contents are such files.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package
    spark = files.sparkSession
    kind = spark.createDataFrame([], f"path string, {_READ}").schema
    fields = to_arrow_schema(kind)
    inline = "content" in files.columns

    def one(path: str | None, content: bytes | None) -> dict:
        try:
            with io.BytesIO(content) if inline else open(path, "rb") as f:
                got = read(f)
            return {"path": path, **got, "tags": list(got["tags"].items()), "read_error": None}
        except Exception as e:  # a row's failure is a value, not the job's
            return {"path": path, "read_error": f"{type(e).__name__}: {e}"}

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                bodies = (x.as_py() for x in part.column(1)) if inline else (None for _ in range(part.num_rows))
                yield pa.RecordBatch.from_pylist([one(p, c) for p, c in zip(part.column(0).to_pylist(), bodies, strict=True)], fields)

    return files.select("path", *(["content"] if inline else [])).mapInArrow(run, kind)


def write_tags(files: DataFrame) -> DataFrame:
    """path, content and write_error of (path, content, tags map<string,string>, and maybe cover: struct<mime, data>); what cannot be written stays as it was."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    kind = files.sparkSession.createDataFrame([], "path string, content binary, write_error string").schema
    fields = to_arrow_schema(kind)
    covers = "cover" in files.columns

    def one(path, content, tags, cover) -> dict:
        try:
            return {"path": path, "content": write(content, {k: v for k, v in tags or [] if v}, (cover["mime"], cover["data"]) if cover else None), "write_error": None}
        except Exception as e:
            return {"path": path, "content": content, "write_error": f"{type(e).__name__}: {e}"}

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                columns = [c.to_pylist() for c in b.slice(lo, 64).columns]
                yield pa.RecordBatch.from_pylist([one(*r) for r in zip(*columns, *([] if covers else [[None] * len(columns[0])]), strict=True)], fields)

    return files.select("path", "content", "tags", *(["cover"] if covers else [])).mapInArrow(run, kind)
