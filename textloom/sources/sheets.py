"""Cells of workbooks, read from their archives."""

from __future__ import annotations

import datetime
import functools
import re
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa

from textloom.sources.archives import Members

# Number formats that mean a date or a time, and the last row that a sheet can have.
_DATE_FORMATS = frozenset((14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47))
_LAST_ROW = 1_048_576
_INT_MAX = (1 << 31) - 1
#: Days of 400 years, after which the calendar repeats, and the day that serial numbers count from.
_ERA, _EPOCH = 146_097, datetime.date(1899, 12, 30).toordinal()

_WHOLE = re.compile(r"\s*([+-]?)0*([0-9]+)\s*", re.ASCII)
_NUMBER = re.compile(r"\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*", re.ASCII)
_ROW_START = re.compile(r"<(?:\w+:)?row[\s/>]", re.ASCII)
_ROW_WHOLE = re.compile(r"<(?:\w+:)?row\b[^>]*/>|<(?:\w+:)?row\b.*</(?:\w+:)?row\s*>", re.ASCII | re.DOTALL)
_ROW_NUMBER = re.compile(r"""<[^>]*\sr\s*=\s*["']([0-9]+)["']""", re.ASCII)
# Rows and strings as most writers write them: text without references, no element but those that count, known attributes.
# Whatever else XML allows is left to expat.
_PLAIN = "[ -%'-;=?-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]"
_PLAIN_T = f'<t(?: xml:space="preserve")?>({_PLAIN}*+)</t>'
_PLAIN_CELL = (
    '<c(?: r="([A-Z]{1,3})[0-9]{1,7}")?(?: s="([0-9]{1,9})")?(?: t="(b|e|n|s|str|inlineStr)")?'
    f"(?:/>|>(?:(?:<f>({_PLAIN}++)</f>)?(?:<v>({_PLAIN}++)</v>)?|<is>{_PLAIN_T}</is>)</c>)"
)
_PLAIN_ROW = re.compile(
    r'<row(?: r="([0-9]{1,10})")?((?: [A-Za-z][A-Za-z0-9:]*="[ !#-%\'-;=?-~]*")*+)(?:/>|>'
    f"((?:{re.sub(r'[(](?![?])', '(?:', _PLAIN_CELL)})*+)</row>)"
)
_PLAIN_CELL = re.compile(_PLAIN_CELL)
_ATTRIBUTE_NAME = re.compile(' ([^ ="]*)="[^"]*"')
_PLAIN_STRINGS = re.compile(rf"(?:<\?xml [^<>]*\?>\s*)?<sst(?: [^<>]*)?>(?:<si>{_PLAIN_T}</si>)*+</sst>\s*")
_PLAIN_STRING = re.compile(f"<si>{_PLAIN_T}")


class Cells:
    """Cells ``(row, col, value, error)`` of many workbooks, by column. Full lists go to Arrow."""

    FULL = 1 << 16
    TYPE = pa.struct([("row", pa.int32()), ("col", pa.int32()), ("value", pa.string()), ("error", pa.string())])

    def __init__(self):
        self._lists, self._stored, self._n_stored = ([], [], [], []), [], 0

    def __len__(self) -> int:
        return self._n_stored + len(self._lists[0])

    def add(self, row: int | None, col: int | None, value: str | None, error: str | None) -> None:
        rows, cols, values, errors = self._lists
        rows.append(row)
        cols.append(col)
        values.append(value)
        errors.append(error)
        if len(rows) >= self.FULL:
            self._store()

    def add_row(self, row: int, cols: list[int | None], values: list[str | None], errors: list[str | None]) -> None:
        lists = self._lists
        lists[0].extend([row] * len(cols))
        lists[1].extend(cols)
        lists[2].extend(values)
        lists[3].extend(errors)
        if len(lists[0]) >= self.FULL:
            self._store()

    def _store(self) -> None:
        fields = list(self.TYPE)
        self._stored.append(pa.StructArray.from_arrays([pa.array(each, f.type) for each, f in zip(self._lists, fields)], fields=fields))
        self._n_stored += len(self._lists[0])
        self._lists = [], [], [], []

    def cut(self, size: int) -> None:
        """Leave the first ``size`` cells."""
        while self._n_stored > size:
            last = self._stored.pop()
            self._n_stored -= len(last)
            self._lists = tuple(last.field(i).to_pylist() for i in range(4))
        for each in self._lists:
            del each[size - self._n_stored :]

    def to_arrow(self) -> pa.Array:
        self._store()
        return pa.concat_arrays(self._stored)


def _local(name: str) -> str:
    return name.rpartition(":")[2]


def _parse(xml: str, start, end, data=None) -> None:
    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler = start, end
    if data is not None:
        parser.CharacterDataHandler = data
    parser.Parse(xml, True)


# Elements are followed down trees of names without prefixes; whatever is not in a tree is below _OTHER.
_OTHER: dict[str, dict] = {}
_FOUND = ":"


def _tree(*paths: str) -> dict[str, dict]:
    """The names along paths; an end holds the number of its path."""
    tree = {}
    for number, path in enumerate(paths):
        node = tree
        for name in path.split("/"):
            node = node.setdefault(name, {})
        node[_FOUND] = number
    return tree


def _elements_at(xml: str | None, tree: dict[str, dict]) -> tuple[list[dict[str, str]], ...]:
    """Attributes of the elements at the paths of a tree of two, by names without prefixes."""
    at, found = [tree], ([], [])

    def start(name: str, attributes: dict[str, str]) -> None:
        node = at[-1].get(_local(name) if ":" in name else name, _OTHER)
        at.append(node)
        if _FOUND in node:
            found[node[_FOUND]].append({_local(k): v for k, v in attributes.items()} if ":" in "".join(attributes) else attributes)

    def end(_) -> None:
        del at[-1]

    if xml is not None:
        _parse(xml, start, end)
    return found


_BOOK = _tree("workbook/bookViews/workbookView", "workbook/sheets/sheet")
_LINKS = _tree("Relationships/Relationship")
_STYLES = _tree("styleSheet/numFmts/numFmt", "styleSheet/cellXfs/xf")


def _active_sheet(book: str | None, links: str | None) -> str | None:
    """Member that holds the active sheet."""
    views, sheets = _elements_at(book, _BOOK)
    links, _ = _elements_at(links, _LINKS)
    active = int(views[0].get("activeTab", 0)) if views else 0
    wanted = sheets[active].get("id") if 0 <= active < len(sheets) else None
    target = next((link.get("Target") for link in links if wanted is not None and link.get("Id") == wanted), None)
    return target if target is None else target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _date_styles(styles: str | None) -> set[int]:
    """Cell styles whose number format shows a date or a time."""

    def shows(code: str) -> bool:
        return re.search("(?i)[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code)) is not None

    custom, cells = _elements_at(styles, _STYLES)
    formats = _DATE_FORMATS.union(int(f["numFmtId"]) for f in custom if "numFmtId" in f and shows(f.get("formatCode", "")))
    return {i for i, cell in enumerate(cells) if int(cell.get("numFmtId", 0)) in formats}


_TEXT, _RUN_TEXT = {}, {}
_STRING = {"t": _TEXT, "r": {"t": _RUN_TEXT}}
_SHARED = {"sst": {"si": _STRING}}


def _shared_strings(xml: str | None) -> list[str]:
    """Shared strings without phonetic hints; of a text that breaks those before."""
    if xml is None:
        return []
    if _PLAIN_STRINGS.fullmatch(xml):
        return _PLAIN_STRING.findall(xml)
    found, pieces, at, into = [], [], [_SHARED], False

    def start(name: str, _) -> None:
        nonlocal into
        node = at[-1].get(_local(name), _OTHER)
        at.append(node)
        if node is _STRING:
            pieces.clear()
        into = node is _TEXT or node is _RUN_TEXT

    def end(_) -> None:
        nonlocal into
        into = False
        if at.pop() is _STRING:
            found.append("".join(pieces))

    def data(text: str) -> None:
        if into:
            pieces.append(text)

    try:
        _parse(xml, start, end, data)
    except expat.ExpatError:
        pass
    return found


def _number_text(value: str) -> str | None:
    """A number as Python prints it, null for what is none."""
    whole = _WHOLE.fullmatch(value)
    if whole:
        sign, digits = whole.groups()
        return f"-{digits}" if sign == "-" and digits != "0" else digits
    return str(float(value)) if _NUMBER.fullmatch(value) else None


def _index(value: str) -> int | None:
    whole = _WHOLE.fullmatch(value)
    return None if whole is None or len(whole[2]) > 10 or int(whole[2]) > _INT_MAX else int(whole[1] + whole[2])


def _date_text(value: str) -> str | None:
    """Days since the end of 1899 as a date and time, or as a time below one day; the 29th of February 1900 counts."""
    serial = float(value) if _NUMBER.fullmatch(value) else None
    if serial is None or abs(serial) > 1e8:
        return None
    micros = serial * 86_400_000_000
    seconds = (int(micros + (0.5 if micros >= 0 else -0.5)) + 500) // 1_000_000
    day, second = divmod(seconds + (86_400 if serial < 60 else 0), 86_400)
    time = f"{second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}"
    if serial < 1:
        return time
    era, day = divmod(_EPOCH + day - 1, _ERA)
    date = datetime.date.fromordinal(day + 1)
    year = date.year + 400 * era
    return f"{'+' if year > 9999 else ''}{year:04d}-{date.month:02d}-{date.day:02d} {time}"


@functools.lru_cache(1 << 15)
def _column(reference: str) -> int:
    """Number of the column that a reference begins with, 0 if it names none."""
    col = 0
    for letter in reference:
        if not "A" <= letter <= "Z":
            break
        col = col * 26 + ord(letter) - 64
    return col


def _shown(kind: str, value: str | None, dated: bool, strings: list[str]) -> tuple[str | None, str | None]:
    """Text and error of a cell without a formula whose text is not its own."""
    if kind not in ("s", "b", "n"):
        return value, None
    if not value:
        return None, None
    if kind == "b":
        return "False" if value.strip(" ") == "0" else "True", None
    if kind == "n":
        text = _date_text(value) if dated else _number_text(value)
        return text, f"no number: {value}" if text is None else None
    index = _index(value)
    if index is None:
        return None, f"no number: {value}"
    return (strings[index], None) if 0 <= index < len(strings) else (None, f"no shared string {index}")


_VALUE, _FORMULA = {}, {}
_CELL = {"v": _VALUE, "f": _FORMULA, "is": _STRING}
_ROW = {"c": _CELL}
_DATA = {"row": _ROW}


class _Rows:
    """The rows of a sheet, told to ``out`` as they end. Formulas show as formulas."""

    def __init__(self, strings: list[str], dates: set[int], out: Cells):
        self._strings, self._dates, self._out, self._before = strings, dates, out, 0

    def _number(self, given: str) -> int:
        """A row without a number follows the one before."""
        number = int(given) if given.isascii() and given.isdecimal() and len(given.lstrip("0")) <= 10 else None
        return self._before + 1 if number is None or number > _INT_MAX else number

    def _fail(self, row: int, why: str) -> None:
        self._out.add(None, None, None, why)
        self._before = row

    def _tell(self, given: str, cols: list[int | None], texts: list[str | None], errors: list[str | None], broken: bool) -> None:
        row = self._number(given)
        if broken:
            return self._fail(row, f"row not well-formed: {row}")
        if row > _LAST_ROW:
            return self._fail(row, "row number too large")
        for skipped in range(self._before + 1, row):
            self._out.add(skipped, 1, None, None)
        if cols:
            self._out.add_row(row, cols, texts, errors)
        else:
            self._out.add(row, 1, None, None)
        self._before = row

    def _read(self, xml: str) -> None:
        """Read a row by expat."""
        at, strings, dates = [_DATA], self._strings, self._dates
        into = place = style = None
        kind, col, given, broken = "n", 0, "", False
        cols, texts, errors = [], [], []
        value, formula, own = [], [], []

        def start(name: str, attributes: dict[str, str]) -> None:
            nonlocal into, place, style, kind, given, cols, texts, errors, broken, col, value, formula, own
            node = at[-1].get(_local(name) if ":" in name else name, _OTHER)
            at.append(node)
            if node is _CELL:
                place, kind, style = attributes.get("r"), attributes.get("t", "n"), attributes.get("s")
                col = _column(place or "") or col + 1
                value, formula, own = None, [], []
            elif node is _VALUE:
                into = value = []
            elif node is _TEXT or node is _RUN_TEXT:
                into = own
            elif node is _FORMULA:
                into = formula = []
            elif node is _ROW:
                given, col, broken = attributes.get("r", ""), 0, False
                cols, texts, errors = [], [], []

        def end(_) -> None:
            nonlocal into, broken
            into = None
            node = at.pop()
            if node is _CELL:
                number = 0 if style is None else _index(style)
                text = error = None
                if number is None:
                    broken = True
                elif col > _INT_MAX:
                    error = f"no column: {place}"
                elif formula:
                    text = f"={''.join(formula)}"
                elif kind == "inlineStr":
                    text = "".join(own)
                else:
                    text, error = _shown(kind, value if value is None else "".join(value), number in dates, strings)
                if text is not None or error is not None:
                    cols.append(col if col <= _INT_MAX else None)
                    texts.append(text)
                    errors.append(error)
            elif node is _ROW:
                self._tell(given, cols, texts, errors, broken)

        def data(text: str) -> None:
            if into is not None:
                into.append(text)

        _parse(xml, start, end, data)

    def _read_plain(self, row: re.Match) -> bool:
        """Read a row as most writers write them; says if it could be."""
        given, more, body = row.groups()
        if more:
            names = _ATTRIBUTE_NAME.findall(more)
            if "r" in names or len(set(names)) < len(names):
                return False
        col, cols, texts, errors = 0, [], [], []
        for letters, style, kind, formula, value, own in _PLAIN_CELL.findall(body) if body else ():
            col, error = _column(letters) if letters else col + 1, None
            if formula:
                text = f"={formula}"
            elif kind == "inlineStr":
                text = own
            else:
                text, error = _shown(kind or "n", value or None, int(style or 0) in self._dates, self._strings)
                if text is None and error is None:
                    continue
            cols.append(col)
            texts.append(text)
            errors.append(error)
        self._tell(given or "", cols, texts, errors, False)
        return True

    def read(self, xml: str) -> None:
        """All rows, each by itself, so one that is not well-formed leaves the others."""
        at = _ROW_START.search(xml)
        while at is not None:
            start = at.start()
            plain = _PLAIN_ROW.match(xml, start)
            end = start + 1 if plain is None else plain.end()
            at = _ROW_START.search(xml, end)
            stop = len(xml) if at is None else at.start()
            if plain is None or xml.find("</row", end, stop) >= 0 or not self._read_plain(plain):
                self._read_alone(_ROW_WHOLE.match(xml, start, stop))

    def _read_alone(self, whole: re.Match | None) -> None:
        size, before, piece = len(self._out), self._before, "" if whole is None else whole[0]
        try:
            self._read(piece)
        except expat.ExpatError:
            self._out.cut(size)
            self._before = before
            given = _ROW_NUMBER.match(piece)
            row = self._number("" if given is None else given[1])
            self._fail(row, f"row not well-formed: {row}")


def broken(problem: Exception) -> str:
    """What is told of a file that could not be read."""
    return "not well-formed" if isinstance(problem, expat.ExpatError) else str(problem) or type(problem).__name__


def _parts(content: bytes | None, found: list) -> Iterator[None]:
    """Put the active sheet, the shared strings and the date styles of a workbook into ``found``, or why not, in several steps."""
    try:
        members = Members(content)
        yield
        book, links, styles, strings = map(members.text, _PARTS)
        yield
        sheet = members.text(_active_sheet(book, links))
        yield
        dates = _date_styles(styles)
        yield
        if sheet is None:
            found.append("active sheet not found")
        else:
            found += sheet, _shared_strings(strings), dates
    except Exception as problem:  # noqa: BLE001
        found[:] = [broken(problem)]


_PARTS = "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/styles.xml", "xl/sharedStrings.xml"
# Small workbooks go through each step together, which spares the processor to fetch the code of all steps for each.
_TOGETHER, _TOGETHER_BYTES = 256, 1 << 18


def _read_together(contents: list[bytes | None], out: Cells) -> Iterator[int]:
    found = [[] for _ in contents]
    steps = list(map(_parts, contents, found))
    while steps:
        steps = [step for step in steps if next(step, steps) is None]
    for parts in found:
        size = len(out)
        try:
            if len(parts) == 1:
                out.add(None, None, None, parts[0])
            else:
                sheet, strings, dates = parts
                _Rows(strings, dates, out).read(sheet)
        except Exception as problem:  # noqa: BLE001
            out.cut(size)
            out.add(None, None, None, broken(problem))
        parts.clear()
        yield len(out)


def read_workbooks(contents: list[bytes | None], out: Cells) -> Iterator[int]:
    """Add the cells of the active sheet of each workbook and tell how many there are then; one that breaks has an error alone."""
    held, size = [], 0
    for content in contents:
        if held and (len(held) == _TOGETHER or size + len(content or b"") > _TOGETHER_BYTES):
            yield from _read_together(held, out)
            held, size = [], 0
        held.append(content)
        size += len(content or b"")
    if held:
        yield from _read_together(held, out)
