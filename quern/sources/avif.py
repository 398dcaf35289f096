"""Metadata of AVIF files: items and profiles cut out, an XMP item put in.

A change is a range of the file, what takes its place, and the box whose body it lies in. From the list of all changes follow
the size fields of the boxes around them and the offsets in the item table, so that nothing else of the file is rebuilt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from quern.sources.containers import Damaged, Part, boxes, build_box, has_gps, is_srgb, spliced

# Fixed values of the formats.
XMP_TYPE, PROFILES = "application/rdf+xml", (b"prof", b"rICC")
IN_FILE, IN_IDAT = 0, 1


@dataclass(frozen=True)
class Change:
    start: int
    end: int
    new: bytes
    owner: Part

    @property
    def growth(self) -> int:
        return len(self.new) - (self.end - self.start)


@dataclass(frozen=True)
class Item:
    """Where an item's bytes are: extents are (index, offset from base, length)."""

    id: int
    construction: int
    reference: int
    base: int
    extents: tuple[tuple[int, int, int], ...]

    def ranges(self) -> list[tuple[int, int]]:
        return [(self.base + at, self.base + at + size) for _, at, size in self.extents]

    def moved(self, to: Callable[[int], int]) -> Item:
        """The item with all places mapped by `to`; its base stays the lowest place if one lies before it now."""
        places = [to(self.base + at) for _, at, _ in self.extents]
        base = min([to(self.base), *places]) if self.base else 0
        return replace(self, base=base, extents=tuple((i, p - base, size) for (i, _, size), p in zip(self.extents, places, strict=True)))


class Fields:
    """Big-endian numbers and texts from a place on."""

    def __init__(self, data: bytes, at: int, end: int):
        self.data, self.at, self.end = data, at, end

    def number(self, width: int) -> int:
        if self.at + width > self.end:
            raise Damaged("a field is cut short")
        self.at += width
        return int.from_bytes(self.data[self.at - width : self.at], "big")

    def text(self) -> str:
        stop = self.data.find(b"\0", self.at, self.end)
        stop = self.end if stop < 0 else stop
        out, self.at = self.data[self.at : stop].decode("latin1"), min(self.end, stop + 1)
        return out


def _put(value: int, width: int) -> bytes:
    if value < 0 or value >> (8 * width):
        raise Damaged("a number does not fit its field")
    return value.to_bytes(width, "big")


def _body(box: Part) -> int:
    return box.end - len(box.payload)


@dataclass(frozen=True)
class Table:
    """The item locations: version, widths of offsets, lengths, bases and indices, and the items."""

    version: int
    widths: tuple[int, int, int, int]
    items: tuple[Item, ...]

    @staticmethod
    def of(data: bytes, box: Part) -> Table:
        f = Fields(data, _body(box), box.end)
        version, _, sizes = f.number(1), f.number(3), f.number(2)
        widths = tuple(sizes >> shift & 15 for shift in (12, 8, 4, 0))
        if version not in (1, 2):
            widths = (*widths[:3], 0)
        wide, items = 4 if version == 2 else 2, []
        for _ in range(f.number(wide)):
            number = f.number(wide)
            construction = f.number(2) & 15 if version else IN_FILE
            reference, base = f.number(2), f.number(widths[2])
            extents = tuple((f.number(widths[3]), f.number(widths[0]), f.number(widths[1])) for _ in range(f.number(2)))
            items.append(Item(number, construction, reference, base, extents))
        return Table(version, widths, tuple(items))

    def packed(self) -> bytes:
        offset, length, base, index = self.widths
        wide = 4 if self.version == 2 else 2
        out = [bytes([self.version, 0, 0, 0, offset << 4 | length, base << 4 | index]), _put(len(self.items), wide)]
        for item in self.items:
            out += [_put(item.id, wide), _put(item.construction, 2) if self.version else b"", _put(item.reference, 2), _put(item.base, base), _put(len(item.extents), 2)]
            for i, at, size in item.extents:
                out += [_put(i, index), _put(at, offset), _put(size, length)]
        return b"".join(out)


class File:
    """The boxes, item types and item table of a file."""

    def __init__(self, data: bytes):
        self.data, self.top = data, list(boxes(data))
        self.meta = next((p for p in self.top if p.kind == "meta"), None)
        if self.meta is None or self.top[-1].end != len(data) or len(self.meta.payload) < 4:
            raise Damaged("a box is cut short or there are no items")
        inner = list(boxes(data, _body(self.meta) + 4, self.meta.end))
        self.inner = {p.kind: p for p in inner}
        if not {"iinf", "iloc"} <= set(self.inner) or inner[-1].end != self.meta.end:
            raise Damaged("the item table is missing or cut short")
        self.table = Table.of(data, self.inner["iloc"])
        f = Fields(data, _body(self.inner["iinf"]), self.inner["iinf"].end)
        self.count_width = 4 if f.number(4) >> 24 else 2
        f.number(self.count_width)
        self.entries = [(*self._entry(p), p) for p in boxes(data, f.at, f.end) if p.kind == "infe"]

    def _entry(self, box: Part) -> tuple[int, str]:
        """(id, kind): exif, xmp, or the item's own type."""
        f = Fields(self.data, _body(box), box.end)
        version, _ = f.number(1), f.number(3)
        if version < 2:
            return f.number(2), ""
        number, _, kind = f.number(2 if version == 2 else 4), f.number(2), _put(f.number(4), 4).decode("latin1")
        f.text()
        return number, "exif" if kind == "Exif" else "xmp" if kind == "mime" and f.text() == XMP_TYPE else kind

    def of_kind(self, *kinds: str) -> dict[int, str]:
        return {number: kind for number, kind, _ in self.entries if kind in kinds}

    def item_data(self, item: Item) -> bytes:
        if item.construction not in (IN_FILE, IN_IDAT) or item.reference or item.construction == IN_IDAT and "idat" not in self.inner:
            return b""
        source = self.data if item.construction == IN_FILE else self.inner["idat"].payload
        return b"".join(source[a : b if self.table.widths[1] else None] for a, b in item.ranges())

    def first_of(self, kind: str) -> bytes | None:
        wanted = self.of_kind(kind)
        return next((self.item_data(i) for i in self.table.items if i.id in wanted), None)

    def primary(self) -> int:
        if "pitm" not in self.inner:
            raise Damaged("there is no primary item")
        f = Fields(self.data, _body(self.inner["pitm"]), self.inner["pitm"].end)
        return f.number(4 if f.number(4) >> 24 else 2)

    def references(self) -> Iterator[tuple[Part, int, int, list[int]]]:
        """(box, width of ids, from, to) of the references between items."""
        if "iref" in self.inner:
            iref = self.inner["iref"]
            width = 4 if iref.payload[:1] > b"\0" else 2
            for box in boxes(self.data, _body(iref) + 4, iref.end):
                f = Fields(self.data, _body(box), box.end)
                yield box, width, f.number(width), [f.number(width) for _ in range(f.number(2))]

    def free_id(self) -> int:
        """An id above those of all items and groups."""
        groups = boxes(self.data, _body(self.inner["grpl"]), self.inner["grpl"].end) if "grpl" in self.inner else ()
        return 1 + max([0, *(n for n, *_ in self.entries), *(i.id for i in self.table.items), *(int.from_bytes(g.payload[4:8], "big") for g in groups)])

    def written(self, changes: list[Change], items: tuple[Item, ...], added: Callable[[Callable[[int], int]], Item] | None = None) -> bytes:
        """The file after changes, with these items and one that `added` gives once it is known where each place moves to."""
        iloc, probe = self.inner["iloc"], (added(lambda at: at),) if added else ()
        # widths are fixed: the table's length is known before its offsets are
        held = Change(_body(iloc), iloc.end, replace(self.table, items=(*items, *probe)).packed(), iloc)
        all_of = [*changes, held]

        def moved(at: int) -> int:
            return at + sum(c.growth if c.end <= at else c.start - at if c.start < at else 0 for c in all_of)

        idat = _body(self.inner["idat"]) if "idat" in self.inner else 0
        inside = lambda at: moved(idat + at) - moved(idat)
        new = [i if i.reference or i.construction not in (IN_FILE, IN_IDAT) else i.moved(moved if i.construction == IN_FILE else inside) for i in items]
        table = replace(self.table, items=(*new, *((added(moved),) if added else ()))).packed()
        edits = [(c.start, c.end, c.new) for c in changes] + [(held.start, held.end, table)]
        return spliced(self.data, edits + list(self._sizes(all_of)))

    def _sizes(self, changes: list[Change]) -> Iterator[tuple[int, int, bytes]]:
        """The size fields of all boxes that changes lie in; a box that ends with the file may name no size."""
        gone = {(c.start, c.end) for c in changes if not c.new}

        def walk(box: Part, skip: int) -> Iterator[tuple[int, int, bytes]]:
            if (box.start, box.end) in gone:
                return
            growth = sum(c.growth for c in changes if _body(box) <= c.owner.start and c.owner.end <= box.end or c.owner.start == box.start)
            size = int.from_bytes(self.data[box.start : box.start + 4], "big")
            if growth and size == 1:
                yield box.start + 8, box.start + 16, _put(box.end - box.start + growth, 8)
            elif growth and size:
                yield box.start, box.start + 4, _put(box.end - box.start + growth, 4)
            if box.kind in ("meta", "iprp", "iref", "ipco"):
                for child in boxes(self.data, _body(box) + skip, box.end):
                    yield from walk(child, 4 if child.kind == "iref" else 0)

        for box in self.top:
            yield from walk(box, 4 if box.kind == "meta" else 0)


def _left(ranges: list[tuple[int, int]], used: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What ranges cover and used does not, merged."""
    edges: dict[int, list[int]] = {}
    for which, spans in enumerate((ranges, used)):
        for a, b in spans:
            if a < b:
                edges.setdefault(a, [0, 0])[which] += 1
                edges.setdefault(b, [0, 0])[which] -= 1
    out: list[tuple[int, int]] = []
    depth, places = [0, 0], sorted(edges)
    for at, until in zip(places, places[1:], strict=False):
        depth = [d + e for d, e in zip(depth, edges[at], strict=True)]
        if depth[0] and not depth[1]:
            if out and out[-1][1] == at:
                out[-1] = (out[-1][0], until)
            else:
                out.append((at, until))
    return out


def _properties(file: File, gone_items: set[int], without_srgb: bool) -> tuple[list[Change], bool]:
    """Changes that take out what is said of items that go, and profiles of sRGB if asked for; whether a profile goes."""
    iprp, changes, profiles = file.inner.get("iprp"), [], []
    inside = list(boxes(file.data, _body(iprp), iprp.end)) if iprp else []
    for ipco in (p for p in inside if p.kind == "ipco"):
        for number, p in enumerate(boxes(file.data, _body(ipco), ipco.end), 1):
            if without_srgb and p.kind == "colr" and p.payload[:4] in PROFILES and is_srgb(p.payload[4:]):
                profiles.append(number)
                changes.append(Change(p.start, p.end, b"", ipco))
    for ipma in (p for p in inside if p.kind == "ipma"):
        f = Fields(file.data, _body(ipma), ipma.end)
        version, flags = f.number(1), f.number(3)
        wide, width = 4 if version else 2, 2 if flags & 1 else 1
        top, rows = 1 << (8 * width - 1), []
        for _ in range(f.number(4)):
            number, said = f.number(wide), [f.number(width) for _ in range(f.number(1))]
            kept = [x - sum(p < x % top for p in profiles) for x in said if x % top not in profiles]
            if number not in gone_items:
                rows.append(_put(number, wide) + _put(len(kept), 1) + b"".join(_put(x, width) for x in kept))
        new = ipma.payload[:4] + _put(len(rows), 4) + b"".join(rows)
        if new != ipma.payload:
            changes.append(Change(_body(ipma), ipma.end, new, ipma))
    return changes, bool(profiles)


def _cut(file: File, gone: set[int], changes: list[Change]) -> bytes:
    """The file after changes and without the items `gone`, their references and the bytes that no other item uses."""
    out, iinf, iref = list(changes), file.inner["iinf"], file.inner.get("iref")
    entries = [p for number, _, p in file.entries if number in gone]
    out += [Change(p.start, p.end, b"", iinf) for p in entries]
    at = _body(iinf) + 4
    out.append(Change(at, at + file.count_width, _put(len(file.entries) - len(entries), file.count_width), iinf))
    kept = [(box, width, source, [t for t in to if t not in gone], len(to)) for box, width, source, to in file.references()]
    lost = [x[0] for x in kept if x[2] in gone or not x[3]]
    if iref and len(lost) == len(kept):
        out.append(Change(iref.start, iref.end, b"", file.meta))
    else:
        out += [Change(p.start, p.end, b"", iref) for p in lost]
        out += [Change(_body(p), p.end, _put(source, w) + _put(len(to), 2) + b"".join(_put(t, w) for t in to), p) for p, w, source, to, n in kept if p not in lost and len(to) < n]
    items = tuple(i for i in file.table.items if i.id not in gone)
    for construction, homes in ((IN_FILE, [p for p in file.top if p is not file.meta]), (IN_IDAT, [file.inner[k] for k in ("idat",) if k in file.inner])):
        spans = lambda of, c=construction: [r for i in of if i.construction == c and not i.reference for r in i.ranges()]
        for a, b in _left(spans(i for i in file.table.items if i.id in gone), spans(items)):
            shift = _body(homes[0]) if construction == IN_IDAT and homes else 0
            home = next((p for p in homes if _body(p) <= a + shift and b + shift <= p.end), None)
            if home is None:
                raise Damaged("an item lies outside the data boxes")
            out.append(Change(a + shift, b + shift, b"", home))
    return file.written(out, items)


def stripped(data: bytes) -> tuple[bytes, list[str]]:
    """An AVIF without EXIF and XMP items and profiles of sRGB, and the kinds that went; its image items and their bytes stay.

    Orientation is a property of the image here, so no EXIF is kept for it. Bytes that another item uses too stay.
    """
    file = File(data)
    gone = file.of_kind("exif", "xmp")
    changes, profile = _properties(file, set(gone), True)
    kinds = {*gone.values()} | ({"icc"} if profile else set())
    if any(has_gps(exif_block(file.item_data(i))) for i in file.table.items if gone.get(i.id) == "exif"):
        kinds.add("gps")
    return (_cut(file, set(gone), changes) if kinds else data), sorted(kinds)


def exif_block(item: bytes) -> bytes:
    """The EXIF of an item, which begins with the distance to it."""
    return item[4 + int.from_bytes(item[:4], "big") :] if len(item) >= 4 else b""


def exif_of(data: bytes) -> bytes:
    return exif_block(File(data).first_of("exif") or b"")


def xmp_of(data: bytes) -> bytes | None:
    return File(data).first_of("xmp")


def with_xmp(data: bytes, packet: bytes | None) -> bytes:
    """The file with this packet as its only XMP item, which describes the primary item; its bytes end the last data box."""
    file = File(data)
    if gone := set(file.of_kind("xmp")):
        data = _cut(file, gone, _properties(file, gone, False)[0])
        file = File(data)
    if packet is None:
        return data
    number, primary = file.free_id(), file.primary()
    wide = number >= 1 << 16
    entry = build_box("infe", bytes([3 if wide else 2, 0, 0, 1]) + _put(number, 4 if wide else 2) + bytes(2) + b"mime\0" + XMP_TYPE.encode() + b"\0\0")
    iinf, iref, at = file.inner["iinf"], file.inner.get("iref"), _body(file.inner["iinf"]) + 4
    width = (4 if iref.payload[:1] > b"\0" else 2) if iref else 4 if wide else 2
    describes = build_box("cdsc", _put(number, width) + _put(1, 2) + _put(primary, width))
    changes = [
        Change(at, at + file.count_width, _put(len(file.entries) + 1, file.count_width), iinf),
        Change(iinf.end, iinf.end, entry, iinf),
        Change(iref.end, iref.end, describes, iref) if iref else Change(file.meta.end, file.meta.end, build_box("iref", bytes([width == 4, 0, 0, 0]) + describes), file.meta),
    ]
    home = next((p for p in reversed(file.top) if p.kind == "mdat"), None)
    if home is not None:
        changes.append(Change(home.end, home.end, packet, home))
        place = lambda moved: moved(home.end) - len(packet)
    elif data[file.top[-1].start : file.top[-1].start + 4] == bytes(4):
        raise Damaged("nothing can follow the last box")
    else:
        place = lambda moved: moved(len(data)) + 8

    def item(moved: Callable[[int], int]) -> Item:
        based = file.table.widths[2] > 0
        return Item(number, IN_FILE, 0, max(0, place(moved)) if based else 0, ((0, 0 if based else max(0, place(moved)), len(packet)),))

    return file.written(changes, file.table.items, item) + (b"" if home is not None else build_box("mdat", packet))

