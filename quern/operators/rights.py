"""Rights fields: merged over carriers, packed as XMP, and the tiers that outputs may carry."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import escape_xml
from quern.schemas import RIGHTS_FIELDS

# Fixed values of the XMP standard: each field's prefix, the prefixes' names, and the packet's wrapper.
PREFIX = {"creator": "dc", "credit": "photoshop", "copyright": "dc", "webStatement": "xmpRights", "licensorUrl": "plus", "digitalSourceType": "Iptc4xmpExt"}
NAMESPACE = {
    "dc": "http://purl.org/dc/elements/1.1/",
    "photoshop": "http://ns.adobe.com/photoshop/1.0/",
    "xmpRights": "http://ns.adobe.com/xap/1.0/rights/",
    "plus": "http://ns.useplus.org/ldf/xmp/1.0/",
    "Iptc4xmpExt": "http://iptc.org/std/Iptc4xmpExt/2008-02-29/",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "x": "adobe:ns:meta/",
}
PACKET = ('<?xpacket begin="\ufeff" id="W5M0MpCehiHzreSzNTczkc9d"?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">', '</rdf:RDF></x:xmpmeta><?xpacket end="w"?>')


def merged(carriers: list[Column]) -> Column:
    """Per field the value of the first carrier that has it."""
    return F.struct(*[F.coalesce(*[c[f] for c in carriers]).alias(f) for f in RIGHTS_FIELDS])


def fields_of(rights: Column) -> Column:
    """The names of the fields that are there, in order."""
    return F.array_compact(F.array(*[F.when(rights[f].isNotNull(), f) for f in RIGHTS_FIELDS]))


def added_fields(own: Column, wanted: Column) -> Column:
    return F.array_except(fields_of(wanted), fields_of(own))


#: How each field stands in a description: its property, and whether as an attribute or as a list of a kind, of plain text, of text with a language, or of resources with one property.
_FORMS = {
    "creator": ("dc:creator", "Seq", "text"),
    "credit": ("photoshop:Credit", None, "text"),
    "copyright": ("dc:rights", "Alt", "lang"),
    "webStatement": ("xmpRights:WebStatement", None, "text"),
    "licensorUrl": ("plus:Licensor", "Bag", "plus:LicensorURL"),
    "digitalSourceType": ("Iptc4xmpExt:DigitalSourceType", None, "text"),
}


def _tag(name: str, attributes: Column | str, inner: Column, empty: Column | None = None) -> Column:
    """empty: whether there is nothing inside, told from what `inner` is made of, so that it is there once; None: never."""
    opened, full = F.lit(f"<{name}"), F.concat(F.lit(">"), inner, F.lit(f"</{name}>"))
    rest = full if empty is None else F.when(empty, F.lit("/>")).otherwise(full)
    return F.concat(opened, F.lit(attributes) if isinstance(attributes, str) else attributes, rest)


def _attribute(name: str, value: Column) -> Column:
    return F.concat(F.lit(f' {name}="'), escape_xml(value), F.lit('"'))


def _item(form: str, value: Column) -> Column:
    if form == "lang":
        return _tag("rdf:li", _attribute("xml:lang", value["lang"]), escape_xml(value["value"]), value["value"] == "")
    if form == "text":
        return _tag("rdf:li", "", escape_xml(value), value == "")
    return _tag("rdf:li", ' rdf:parseType="Resource"', _tag(form, "", escape_xml(value), value == ""))


def _void(form: str, values: Column) -> Column:
    """Whether none of the values makes an item."""
    return F.forall(values, (lambda v: v["lang"].isNull() | v["value"].isNull()) if form == "lang" else (lambda v: v.isNull()))


def xmp_packet(rights: Column) -> Column:
    """The compact packet of a struct with creator and licensorUrl as arrays, copyright as array<struct<lang,value>> and text otherwise; null without fields."""
    joined = lambda parts: F.concat(*[F.coalesce(p, F.lit("")) for p in parts]) if parts else F.lit("")
    there = {f: rights[f].isNotNull() for f in _FORMS}
    spaces = [F.when(reduce(Column.__or__, [there[f] for f in _FORMS if PREFIX[f] == p]), F.lit(f' xmlns:{p}="{NAMESPACE[p]}"')) for p in dict.fromkeys(PREFIX.values())]
    short = [F.when(there[f], _attribute(name, rights[f])) for f, (name, kind, _) in _FORMS.items() if kind is None]
    listed = {f: form for f, form in _FORMS.items() if form[1] is not None}
    lists = [F.when(there[f], _tag(name, "", _tag(f"rdf:{kind}", "", F.array_join(F.transform(rights[f], partial(_item, form)), ""), _void(form, rights[f])))) for f, (name, kind, form) in listed.items()]
    described = _tag("rdf:Description", joined([F.lit(' rdf:about=""'), *spaces, *short]), joined(lists), ~reduce(Column.__or__, [there[f] for f in listed]))
    return F.when(F.size(fields_of(rights)) > 0, F.concat(F.lit(PACKET[0]), described, F.lit(PACKET[1])))


def tiers(own: Column, full: Column, strip_all: bool, only_rights: Column) -> Column:
    """array<struct<tier, fields, packet>>: all wanted fields; the file's own, if others were added and it has some; none, unless the
    last has no packet or the input is already only its rights. packet is the packet's size in bytes, null for none.
    """
    nothing = F.array().cast("array<string>")
    row = lambda n, fields, size: F.struct(n.cast("int").alias("tier"), fields.alias("fields"), size.cast("int").alias("packet"))
    if strip_all:
        return F.array(row(F.lit(0), nothing, F.lit(None)))
    sizes = F.struct(fields_of(own).alias("own"), fields_of(full).alias("full"), F.octet_length(xmp_packet(own)).alias("own_size"), F.octet_length(xmp_packet(full)).alias("full_size"))

    def listed(s: Column) -> Column:
        adds = (F.size(F.array_except(s["full"], s["own"])) > 0) & (F.size(s["own"]) > 0)
        last = F.when(adds, s["own_size"]).otherwise(s["full_size"])
        none = row(F.when(adds, 2).otherwise(1), nothing, F.lit(None))
        return F.array_compact(F.array(row(F.lit(0), s["full"], s["full_size"]), F.when(adds, row(F.lit(1), s["own"], s["own_size"])), F.when(last.isNotNull() & ~only_rights, none)))

    # packets are long expressions: they stand in one row of an array, which the tiers are made from
    return F.transform(F.array(sizes), listed)[0]


def missing_fields(outputs: DataFrame) -> DataFrame:
    """outputs (file, wanted, carried: arrays of names) to (file, missing): wanted fields that some output lacks, in field order."""
    lacks = outputs.select("file", F.explode(F.array_except("wanted", "carried")).alias("field")).groupBy("file").agg(F.collect_set("field").alias("fields"))
    order = F.array(*[F.lit(f) for f in RIGHTS_FIELDS])
    return lacks.select("file", F.filter(order, lambda f: F.array_contains("fields", f)).alias("missing"))
