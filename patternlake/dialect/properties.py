"""Unicode properties as Java set texts, code point ranges or strings.

Java knows general categories by short name, scripts and some binary properties.  All others
are asked of the Unicode library that Spark ships, through the session's JVM; where no session
is at hand, of the ``regex`` module, if it is installed.  Each has its own Unicode version.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: Long names of general categories (fixed values of the Unicode standard).
CATEGORIES = {
    "Letter": "L", "Cased_Letter": "LC", "Uppercase_Letter": "Lu", "Lowercase_Letter": "Ll", "Titlecase_Letter": "Lt", "Modifier_Letter": "Lm", "Other_Letter": "Lo",
    "Mark": "M", "Combining_Mark": "M", "Nonspacing_Mark": "Mn", "Spacing_Mark": "Mc", "Enclosing_Mark": "Me",
    "Number": "N", "Decimal_Number": "Nd", "digit": "Nd", "Letter_Number": "Nl", "Other_Number": "No",
    "Punctuation": "P", "punct": "P", "Connector_Punctuation": "Pc", "Dash_Punctuation": "Pd", "Open_Punctuation": "Ps", "Close_Punctuation": "Pe", "Initial_Punctuation": "Pi", "Final_Punctuation": "Pf", "Other_Punctuation": "Po",
    "Symbol": "S", "Math_Symbol": "Sm", "Currency_Symbol": "Sc", "Modifier_Symbol": "Sk", "Other_Symbol": "So",
    "Separator": "Z", "Space_Separator": "Zs", "Line_Separator": "Zl", "Paragraph_Separator": "Zp",
    "Other": "C", "Control": "Cc", "cntrl": "Cc", "Format": "Cf", "Surrogate": "Cs", "Private_Use": "Co", "Unassigned": "Cn",
}
#: Binary properties that Java has under the same name, and their short names.
BINARY_JAVA = {
    "Alphabetic": "IsAlphabetic", "Alpha": "IsAlphabetic", "Ideographic": "IsIdeographic", "Ideo": "IsIdeographic", "Lowercase": "IsLowercase", "Lower": "IsLowercase", "Uppercase": "IsUppercase", "Upper": "IsUppercase",
    "White_Space": "IsWhite_Space", "space": "IsWhite_Space", "Hex_Digit": "IsHex_Digit", "Join_Control": "IsJoin_Control", "Noncharacter_Code_Point": "IsNoncharacter_Code_Point",
    "ID_Start": "javaUnicodeIdentifierStart", "IDS": "javaUnicodeIdentifierStart", "XID_Start": "javaUnicodeIdentifierStart",
}
#: Binary properties of the dialect and their short names (fixed values of the Unicode standard).
BINARY = {
    "ASCII": "", "ASCII_Hex_Digit": "AHex", "Alphabetic": "Alpha", "Any": "", "Assigned": "", "Bidi_Control": "Bidi_C", "Bidi_Mirrored": "Bidi_M", "Case_Ignorable": "CI", "Cased": "",
    "Changes_When_Casefolded": "CWCF", "Changes_When_Casemapped": "CWCM", "Changes_When_Lowercased": "CWL", "Changes_When_NFKC_Casefolded": "CWKCF", "Changes_When_Titlecased": "CWT", "Changes_When_Uppercased": "CWU",
    "Dash": "", "Default_Ignorable_Code_Point": "DI", "Deprecated": "Dep", "Diacritic": "Dia", "Emoji": "", "Emoji_Component": "EComp", "Emoji_Modifier": "EMod", "Emoji_Modifier_Base": "EBase", "Emoji_Presentation": "EPres",
    "Extended_Pictographic": "ExtPict", "Extender": "Ext", "Grapheme_Base": "Gr_Base", "Grapheme_Extend": "Gr_Ext", "Hex_Digit": "Hex", "IDS_Binary_Operator": "IDSB", "IDS_Trinary_Operator": "IDST", "IDS_Unary_Operator": "IDSU",
    "ID_Compat_Math_Continue": "", "ID_Compat_Math_Start": "", "ID_Continue": "IDC", "ID_Start": "IDS", "Ideographic": "Ideo", "Join_Control": "Join_C", "Logical_Order_Exception": "LOE", "Lowercase": "Lower", "Math": "",
    "Noncharacter_Code_Point": "NChar", "Pattern_Syntax": "Pat_Syn", "Pattern_White_Space": "Pat_WS", "Quotation_Mark": "QMark", "Radical": "", "Regional_Indicator": "RI", "Sentence_Terminal": "STerm", "Soft_Dotted": "SD",
    "Terminal_Punctuation": "Term", "Unified_Ideograph": "UIdeo", "Uppercase": "Upper", "Variation_Selector": "VS", "White_Space": "space", "XID_Continue": "XIDC", "XID_Start": "XIDS",
}
#: Properties of strings (fixed values of the Unicode standard).
OF_STRINGS = ("Basic_Emoji", "Emoji_Keycap_Sequence", "RGI_Emoji", "RGI_Emoji_Flag_Sequence", "RGI_Emoji_Modifier_Sequence", "RGI_Emoji_Tag_Sequence", "RGI_Emoji_ZWJ_Sequence")

Ranges = tuple[tuple[int, int], ...]
_ANY, _ASCII = ((0, 0x10FFFF),), ((0, 0x7F),)


class Unavailable(Exception):
    """No library at hand knows the property."""


def _library(expression: str):
    """A set of the JVM's Unicode library; None without a session."""
    from pyspark import SparkContext

    context = SparkContext._active_spark_context
    return None if context is None or context._jvm is None else context._jvm.com.ibm.icu.text.UnicodeSet(f"[\\p{{{expression}}}]")


def _parsed(pattern: str) -> Ranges:
    """The ranges of a resolved set as the library prints it: characters and escapes, ``-`` between ends, strings in braces."""
    pattern = re.sub(r"(?<!\\)\{[^}]*\}", "", pattern)
    tokens = re.findall(r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]", pattern[1:-1], re.S)
    out: list[list[int]] = []
    dash = False
    for t in tokens:
        if t == "-":
            dash = True
            continue
        code = int(t[2:], 16) if t[:2] in ("\\u", "\\U") and len(t) > 2 else ord(t[-1])
        if dash:
            out[-1][1] = code
        else:
            out.append([code, code])
        dash = False
    return tuple((a, b) for a, b in out)


@lru_cache(maxsize=256)
def _from_jvm(expression: str) -> Ranges | None:
    found = _library(expression)
    # Complements are resolved; sets as they are made print their own expression.
    return None if found is None else _parsed(found.complement().complement().toPattern(True))


@lru_cache(maxsize=64)
def _from_python(expression: str) -> Ranges:
    try:
        import regex

        search = regex.compile(f"\\p{{{expression}}}+")
    except Exception as error:  # not installed, or it doesn't know the property
        raise Unavailable(expression) from error
    every = "".join(map(chr, range(0x110000)))
    return tuple((m.start(), m.end() - 1) for m in search.finditer(every))


def ranges_of(expression: str) -> Ranges:
    """The code points of a property expression."""
    known = {"Any": _ANY, "ASCII": _ASCII}.get(expression)
    if known is None:
        known = _from_jvm(expression)
    if known is None:
        _from_jvm.cache_clear()  # there may be a session next time
        known = _from_python(expression)
    return known


def strings_of(name: str) -> tuple[Ranges, tuple[str, ...]]:
    """Code points and longer strings of a property of strings."""
    found = _library(name)
    if found is None:
        raise Unavailable(name)
    from pyspark import SparkContext

    joined = SparkContext._active_spark_context._jvm.java.lang.String.join("\n", found.strings())
    return ranges_of(name), tuple(joined.split("\n")) if joined else ()


def _loose(name: str) -> str:
    return "".join(c for c in name.lower() if c not in "_- ")


def _script(name: str) -> str | None:
    """A script as Java knows it; names that it doesn't know are none."""
    if not name or not name.replace("_", "").isalnum():
        return None
    try:
        ranges_of(f"sc={name}")
    except Exception:
        return None
    return name


def lookup(name: str, strict: bool) -> tuple[Ranges, str] | None:
    """Ranges, or a Java set text, of a property expression; None if there is none.

    A lone name is a binary property, else a category, else a script with its extensions.
    Names are matched loosely unless ``strict``.  Raises ``Unavailable`` where no library at
    hand has the property.
    """
    key, equals, value = name.partition("=")

    def of(table: dict, wanted: str):
        if wanted in table:
            return table[wanted]
        return None if strict else next((v for k, v in table.items() if _loose(k) == _loose(wanted)), None)

    def category(wanted: str) -> tuple[Ranges, str] | None:
        short = {v: v for v in CATEGORIES.values()}
        found = of(short, wanted) or of(CATEGORIES, wanted)
        return None if found is None else ((), "[\\p{Lu}\\p{Ll}\\p{Lt}]" if found == "LC" else f"\\p{{{found}}}")

    def script(wanted: str) -> tuple[Ranges, str] | None:
        return ((), f"\\p{{script={wanted}}}") if _script(wanted) else None

    def extended(wanted: str) -> tuple[Ranges, str] | None:
        return (ranges_of(f"scx={wanted}"), "") if _script(wanted) else None

    if equals:
        known = {"gc": category, "General_Category": category, "sc": script, "Script": script, "scx": extended, "Script_Extensions": extended}
        kind = of(known, key)
        return kind(value) if kind else None
    if (java := of(BINARY_JAVA, name)) is not None:
        return (), f"\\p{{{java}}}"
    if of({"Assigned": 1}, name):
        return (), "\\P{Cn}"
    if (binary := of({n: long for long, short in BINARY.items() for n in (long, short) if n}, name)) is not None:
        return ranges_of(binary), ""
    return category(name) or extended(name)
