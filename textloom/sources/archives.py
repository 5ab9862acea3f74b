"""Members of zip archives that are held in memory."""

from __future__ import annotations

import codecs
import io
import struct
import zipfile
import zlib

_END = struct.Struct("<4s4H2LH")
_ENTRY = struct.Struct("<4s4B4H3L5H2L")
_LOCAL = struct.Struct("<4s2B4H3L2H")
# Flags that change nothing here: how hard a member was packed, sizes told after it, a name in UTF-8.
_KNOWN_FLAGS = 0x80E


def _cut(name: bytes) -> bool:
    return b"\0" in name


class Members:
    """The members of an archive. Plain ones are read here; whatever ``zipfile`` has a rule for is left to it, errors too."""

    def __init__(self, content: bytes | None):
        self._content, self._archive = content or b"", None
        self._plain = self._directory()

    def _directory(self) -> dict[str, tuple[int, ...]] | None:
        """``(start, method, checksum, packed size, size)`` by name; null if the archive is not a plain one, written in order."""
        content = self._content
        stop = len(content) - _END.size
        if stop < 0:
            return None
        mark, disk, first, here, entries, length, place, noted = _END.unpack_from(content, stop)
        if mark != b"PK\5\6" or disk or first or noted or here != entries or place + length != stop:
            return None
        found, free, end = {}, place, 0
        for _ in range(entries):
            if place + _ENTRY.size > stop:
                return None
            mark, _, _, needed, _, flags, method, _, _, checksum, packed, size, named, extra, noted, disk, _, _, start = _ENTRY.unpack_from(content, place)
            # Members that overlap are left to zipfile, too.
            if mark != b"PK\1\2" or needed > 63 or flags & ~_KNOWN_FLAGS | extra | disk or (method != 8 and method) or start < end:
                return None
            name = content[place + _ENTRY.size : place + _ENTRY.size + named]
            end = start + _LOCAL.size + named + packed
            found[name] = start, method, checksum, packed, size
            place += _ENTRY.size + named + noted
        plain = place == stop and end <= free and len(found) == entries and all(map(bytes.isascii, found)) and not any(map(_cut, found))
        return found if plain else None

    def _taken(self, name: bytes) -> bytes | None:
        """A member of a plain archive; null if something about it is odd."""
        start, method, checksum, packed, size = self._plain[name]
        mark, _, _, told, *_, named, extra = _LOCAL.unpack_from(self._content, start)
        begin = start + _LOCAL.size + named
        if mark != b"PK\3\4" or told & ~_KNOWN_FLAGS or extra or self._content[begin - named : begin] != name:
            return None
        raw = self._content[begin : begin + packed]
        if method:
            try:
                raw = zlib.decompress(raw, -15, size + 1)
            except zlib.error:
                return None
        return raw if len(raw) == size and zlib.crc32(raw) == checksum else None

    def read(self, name: str) -> bytes | None:
        """A member; null if the archive has none of that name."""
        if self._plain is not None and name.isascii():
            key = name.encode()
            if key not in self._plain:
                return None
            raw = self._taken(key)
            if raw is not None:
                return raw
        if self._archive is None:
            self._archive = zipfile.ZipFile(io.BytesIO(self._content))
        return self._archive.read(name) if name in self._archive.NameToInfo else None

    def text(self, name: str | None) -> str | None:
        """Text of a member; null if the archive has none of that name."""
        raw = None if name is None else self.read(name)
        if raw is None:
            return None
        if raw.startswith((b"\xff\xfe", b"\xfe\xff")):
            return raw.decode("utf-16")
        return raw.removeprefix(codecs.BOM_UTF8).decode()
