"""SVG as text: facts, and removal of what does not show."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

# Namespaces of editors, and how ids are referred to.
EDITORS = ("http://www.inkscape.org/namespaces/inkscape", "http://sodipodi.sourceforge.net/DTD/sodipodi-0.dtd", "http://ns.adobe.com/AdobeIllustrator/10.0/", "http://www.bohemiancoding.com/sketch/ns", "http://www.figma.com/figma/ns", "http://www.serif.com/")
_URL, _HASH = re.compile(r"url\(\s*[\"']?#([^\"')]+)[\"']?\s*\)"), re.compile(r"^#(.+)$")
_COMMENT = re.compile(r"<!--(?!!).*?-->", re.S)


def inspect_svg(text: str) -> dict:
    """viewBox, title, ids that are defined and referred to (sorted), and the kinds of metadata; ValueError for broken XML."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise ValueError(f"E_DECODE: {e}") from e
    ids, used, title, kinds = set(), set(), None, set()
    if _COMMENT.search(text):
        kinds.add("comment")
    for node in root.iter():
        space, _, name = node.tag[1:].rpartition("}") if node.tag.startswith("{") else ("", "", node.tag)
        if space.startswith(EDITORS) or name == "metadata":
            kinds.add("editor" if space.startswith(EDITORS) else "metadata")
        if name == "title" and title is None:
            title = (node.text or "").strip() or None
        for key, value in node.attrib.items():
            if key.startswith("{") and key[1:].startswith(EDITORS):
                kinds.add("editor")
            if key == "id":
                ids.add(value)
            used.update(_URL.findall(value))
            if key.rpartition("}")[2] == "href":
                used.update(_HASH.findall(value))
        if name == "style" and node.text:
            used.update(_URL.findall(node.text))
    return {"viewBox": root.get("viewBox"), "title": title, "referencedIds": sorted(ids & used), "metadata": sorted(kinds)}


def strip_svg(text: str) -> str:
    """The markup without comments (other than <!--!), metadata elements and what editors add; the rest stays byte for byte."""
    prefixes = [p for p, uri in re.findall(r"xmlns:([\w.-]+)\s*=\s*[\"']([^\"']+)[\"']", text) if uri.startswith(EDITORS)]
    out = _COMMENT.sub("", text)
    out = re.sub(r"<metadata\b[^>]*?(?:/>|>.*?</metadata\s*>)", "", out, flags=re.S)
    for p in map(re.escape, prefixes):
        out = re.sub(rf"<{p}:([\w.-]+)\b[^>]*?(?:/>|>.*?</{p}:\1\s*>)", "", out, flags=re.S)
        out = re.sub(rf"\s+(?:xmlns:{p}|{p}:[\w.-]+)\s*=\s*(?:\"[^\"]*\"|'[^']*')", "", out)
    return out


def rounded_svg(text: str, precision: int) -> str:
    """Path data and coordinates with fewer decimals."""
    number = re.compile(r"-?\d*\.\d+(?:[eE][-+]?\d+)?")
    short = lambda m: (f"{float(m[0]):.{precision}f}".rstrip("0").rstrip(".") or "0").replace("-0.", "-.").removeprefix("0") or "0"
    attribute = re.compile(r"(\s(?:d|points|transform|x|y|x1|x2|y1|y2|cx|cy|r|rx|ry|width|height)\s*=\s*)(\"[^\"]*\"|'[^']*')")
    return attribute.sub(lambda m: m[1] + number.sub(short, m[2]), text)
