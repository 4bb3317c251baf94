"""Addresses as canonical text, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda over an array of one element."""
    return F.transform(F.array(value), body)[0]


def _hex(number: Column) -> Column:
    return F.lower(F.hex(number))


def _groups(half: Column) -> Column:
    return F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":"))


def _expanded(address: Column) -> Column:
    """The eight groups, without leading zeros; null if the address is none. A dotted tail counts as two groups."""
    octets = F.transform(F.split(F.regexp_extract(address, rf":({_IPV4})$", 1), r"\."), lambda x: x.try_cast("int"))
    pair = lambda o, i: _hex(F.get(o, F.lit(i)) * 256 + F.get(o, F.lit(i + 1)))
    tail = _let(octets, lambda o: F.concat(pair(o, 0), F.lit(":"), pair(o, 2)))
    plain = F.when(F.contains(address, F.lit(".")), F.concat(F.regexp_extract(address, rf"^(.*:){_IPV4}$", 1), tail)).otherwise(address)

    def whole(halves: Column) -> Column:
        left, right = _groups(halves[0]), _groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
        zeros = F.lit(8) - F.size(left) - F.size(right)
        filled = F.when(F.size(halves) == 1, left).when((F.size(halves) == 2) & (zeros > 0), F.concat(left, F.array_repeat(F.lit("0"), zeros), right))
        return _let(filled, lambda g: F.when((F.size(g) == 8) & F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$")), g))

    groups = _let(F.split(plain, "::", 3), whole)
    return F.transform(groups, lambda x: F.regexp_replace(x, "^0+(?=.)", ""))


def _shortened(groups: Column) -> Column:
    """The groups' text with the longest run of two or more zeros, the first of equal ones, as a double colon."""
    mapped = F.array_join(F.slice(groups, 1, 6), ":") == "0:0:0:0:0:ffff"
    low = [F.conv(F.get(groups, F.lit(i)), 16, 10).try_cast("int") for i in (6, 7)]
    dotted = F.concat_ws(".", *[x.cast("string") for g in low for x in (F.floor(g / 256), g % 256)])

    def short(text: Column) -> Column:
        out = F.when(F.lit(False), text)
        for n in range(8, 1, -1):
            run = rf"^(|.*?:)0(?::0){{{n - 1}}}(?=:|$):?(.*)$"
            out = out.when(text.rlike(run), F.regexp_replace(text, run, "$1:$2"))
        return out.otherwise(text)

    def closed(text: Column) -> Column:
        """A run at the very beginning or end needs one colon more."""
        first = F.when(text.startswith(":") & ~text.startswith("::"), ":").otherwise("")
        last = F.when(text.endswith(":") & ~text.endswith("::"), ":").otherwise("")
        return F.when(text == ":", "::").otherwise(F.concat(first, text, last))

    return F.when(mapped, F.concat(F.lit("::ffff:"), dotted)).otherwise(_let(_let(F.array_join(groups, ":"), short), closed))


def ip_texts(*values: Column) -> Column:
    """An array of the values as canonical text of an IPv4 or IPv6 address (lower case, shortest form, an IPv4-mapped one
    with a dotted tail, a zone kept); null for what is none. White space around it does not count."""

    def six(text: Column) -> Column:
        parts = F.split(text, "%", 2)
        zone = F.get(parts, F.lit(1))
        end = F.when(zone.isNull(), "").when((zone != "") & ~F.contains(zone, F.lit("%")), F.concat(F.lit("%"), zone))
        return _let(_expanded(F.lower(parts[0])), lambda g: F.when(g.isNotNull(), F.concat(_shortened(g), end)))

    def one(text: Column) -> Column:
        return F.when(F.contains(text, F.lit(":")), six(text)).when(text.rlike(f"^{_IPV4}$"), text)

    bare = F.transform(F.array(*values), lambda v: F.regexp_replace(v, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    return F.transform(bare, one)


def ip_text(value: Column) -> Column:
    """One value of ip_texts()."""
    return ip_texts(value)[0]
