"""Text rules: scripts, clean-up, list markers, section numbers, joining of lines, output encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space, as CJK, and as the end of a sentence.
SPACE = "\\t\\n\\x0B\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"
BLANKS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
CJK = "\\x{1100}-\\x{11FF}\\x{2E80}-\\x{2EFF}\\x{3000}-\\x{303F}\\x{3040}-\\x{30FF}\\x{3100}-\\x{312F}\\x{3130}-\\x{318F}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{A960}-\\x{A97F}\\x{AC00}-\\x{D7AF}\\x{F900}-\\x{FAFF}\\x{FE30}-\\x{FE4F}\\x{FF00}-\\x{FF60}\\x{FFE0}-\\x{FFE6}\\x{20000}-\\x{2FFFF}"
NOT_IN_XML = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F\\x{FFFE}\\x{FFFF}]"
BROKEN = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{FFFD}]"
SENTENCE_END = "[.。!！?？;；:：\"”』」）)]"
BULLET = r"\A(?:([•·▪◦‣⁃●○■□∙])(?:[" + SPACE + r"]+|(?=[㐀-鿿（【「]))|([*–—-])[" + SPACE + "]+)"
ORDERED = r"\A(\(?[0-9]+(?:\.[0-9]+)*[.)）、]|\(?[a-zA-Z][.)）]|[①-⑳]|[一二三四五六七八九十百]+[、.)]|（[0-9]+）|\([0-9]+\))[" + SPACE + "]*"
CJK_DIGITS = "〇一二三四五六七八九"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: astral characters count twice."""
    # plain texts have none to count
    return F.length(text) + F.when(F.octet_length(text) > F.length(text), F.regexp_count(text, F.lit("[\\x{10000}-\\x{10FFFF}]"))).otherwise(0)


def contains_cjk(text: Column) -> Column:
    # most texts fail the first test, of one range, and are spared the other
    return text.rlike("[\\x{1100}-\\x{10FFFF}]") & text.rlike(f"[{CJK}]")


def cjk_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{CJK}]"))


def sanitize(text: Column) -> Column:
    """Without control characters (tab, line feed and carriage return stay) and noncharacters; U+FFFD stays."""
    return F.regexp_replace(text, NOT_IN_XML, "")


def broken_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(BROKEN))


def ends_sentence(text: Column) -> Column:
    """The last character after trimming on the right ends a sentence; so does the empty text."""
    last = F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1))
    return (last == "") | last.rlike(SENTENCE_END)


def list_marker(text: Column) -> Column:
    """struct(ordered, marker, style, rest), null where a line starts with no marker."""
    bullet, ordered = F.regexp_extract(text, BULLET, 0), F.regexp_extract(text, ORDERED, 0)
    sign = F.concat(F.regexp_extract(text, BULLET, 1), F.regexp_extract(text, BULLET, 2))
    marker = F.regexp_extract(text, ORDERED, 1)
    style = F.when(marker.rlike(r"\A[(（]") | marker.rlike(r"\A[0-9]+\.[0-9]"), "other").when(marker.rlike(r"\A[0-9]+[.)]\z"), "decimal").when(marker.rlike(r"\A[a-zA-Z][.)]\z"), "letter").otherwise("other")

    def made(is_ordered: bool, mark: Column, how: Column, whole: Column) -> Column:
        return F.struct(F.lit(is_ordered).alias("ordered"), mark.alias("marker"), how.alias("style"), F.substring(text, F.length(whole) + 1, F.length(text)).alias("rest"))

    year = marker.rlike(r"\A[0-9]{4}[.)]")
    # most lines fail this one test and go through none of the others
    likely = text.rlike(r"\A(?:[•·▪◦‣⁃●○■□∙*–—①-⑳（-]|\(?[0-9]|\(?[a-zA-Z][.)）]|[一二三四五六七八九十百])")
    return F.when(~likely, None).when(bullet != "", made(False, sign, F.lit("bullet"), bullet)).when((ordered != "") & ~year, made(True, marker, style, ordered))


def section_depth(text: Column) -> Column:
    """1 to 4 for lines that start with a dotted number of parts of up to three digits; else null."""
    number = F.regexp_extract(text, r"\A[" + SPACE + r"]*([0-9]{1,3}(?:\.[0-9]{1,3})*)[" + SPACE + "]+[^" + SPACE + "]", 1)
    depth = F.size(F.split(number, r"\."))
    return F.when((number != "") & (depth <= 4), depth)


def cjk_section_level(text: Column) -> Column:
    t = trimmed(text)
    return F.when(t.rlike(r"\A[一二三四五六七八九十]+、"), 2).when(t.rlike(r"\A[（(][一二三四五六七八九十]+[）)]"), 3)


def join_action(left: Column, right: Column) -> Column:
    """How a line follows another: `dehyphen`, `none` or `space`."""
    hyphen = left.rlike(r"[A-Za-z][-\x{AD}]\z") & right.rlike(r"\A[a-z]")
    plain = (left == "") | (right == "") | left.rlike(f"[{SPACE}]\\z") | left.rlike(f"[{CJK}]\\z") | right.rlike(f"\\A[{CJK}]")
    return F.when((left != "") & hyphen, "dehyphen").when(plain, "none").otherwise("space")


def join_lines(lines: Column) -> Column:
    """Lines of a paragraph as one text. How two lines meet depends on the end of one and the start of the next only, so
    that every line is looked at beside its neighbours, and nothing is folded."""

    def met(a: Column, b: Column) -> Column:
        return join_action(F.right(a, F.lit(2)), F.substring(b, 1, 1))

    def piece(x: Column, action: Column, after: Column) -> Column:
        cut = F.when(F.coalesce(after == "dehyphen", F.lit(False)), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x)
        return F.concat(F.when(action == "space", " ").otherwise(""), cut)

    # kept lines and actions are variables of a lambda each, since a plain expression would be made anew for every line
    def joined(kept: Column) -> Column:
        actions = F.transform(kept, lambda x, i: F.when(i > 0, met(F.get(kept, i - 1), x)))
        return F.get(F.transform(F.array(actions), lambda a: F.array_join(F.transform(kept, lambda x, i: piece(x, F.get(a, i), F.get(a, i + 1))), "")), F.lit(0))

    return F.get(F.transform(F.array(F.filter(lines, lambda x: x != "")), joined), F.lit(0))


def repeat_key(text: Column) -> Column:
    """Running heads are compared with numbers as #, blanks collapsed, in lower case."""
    return F.lower(trimmed(F.regexp_replace(F.regexp_replace(text, "[0-9]+", "#"), f"[{SPACE}]+", " ")))


def is_page_number(text: Column) -> Column:
    return text.rlike(f"\\A[-—–{SPACE}]*[0-9]{{1,4}}[-—–{SPACE}]*\\z")


def replace_astral(text: Column) -> Column:
    """struct(text, replaced): characters beyond the basic plane become a white square."""
    astral = "[\\x{10000}-\\x{10FFFF}]"
    return F.struct(F.regexp_replace(text, astral, "□").alias("text"), F.regexp_count(text, F.lit(astral)).alias("replaced"))


def ucs2_hex(text: Column) -> Column:
    return F.lower(F.hex(F.encode(text, "UTF-16BE")))


def safe_base_name(name: Column) -> Column:
    base = F.regexp_replace(F.regexp_replace(name, r"\.[^.]+\z", ""), r'[\\/:*?"<>|]', "_")
    return F.when(base == "", "document").otherwise(base)


def alpha(n: Column) -> Column:
    """1 -> a, 26 -> z, 27 -> aa."""
    letter = lambda v: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (v % 26 + 1).cast("int"), F.lit(1))
    start = F.struct(n.cast("long").alias("v"), F.lit("").alias("s"))
    step = lambda a, _: F.when(a["v"] > 0, F.struct(F.floor((a["v"] - 1) / 26).cast("long").alias("v"), F.concat(letter(a["v"] - 1), a["s"]).alias("s"))).otherwise(a)
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda a: a["s"])


def roman(n: Column) -> Column:
    # The numerals.
    values = {1000: "m", 900: "cm", 500: "d", 400: "cd", 100: "c", 90: "xc", 50: "l", 40: "xl", 10: "x", 9: "ix", 5: "v", 4: "iv", 1: "i"}
    out, rest = F.lit(""), n.cast("int")
    for value, sign in values.items():
        out, rest = F.concat(out, F.repeat(F.lit(sign), F.floor(rest / value).cast("int"))), rest % value
    return out


def cjk_decimal(n: Column) -> Column:
    return F.translate(n.cast("string"), "0123456789", CJK_DIGITS)


# Formal digits, and the syllables of counting.
CJK_FORMAL = "零壹贰叁肆伍陆柒捌玖"
KATAKANA = "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワヲン"


def chinese(n: Column, digits: str) -> Column:
    """1 to 9999 in words: a zero stands for places left out between others; ten to nineteen have no leading one."""
    place = lambda k: F.floor(n / 10**k).cast("int") % 10
    digit = lambda d: F.substring(F.lit(digits), d + 1, F.lit(1))
    ones, tens, hundreds, thousands = (place(k) for k in range(4))
    out = [F.when(thousands > 0, F.concat(digit(thousands), F.lit("千")))]
    out.append(F.when(hundreds > 0, F.concat(digit(hundreds), F.lit("百"))).when((thousands > 0) & ((tens > 0) | (ones > 0)), digits[0]))
    out.append(F.when(tens > 0, F.concat(F.when(n < 20, "").otherwise(digit(tens)), F.lit("十"))).when((hundreds > 0) & (ones > 0), digits[0]))
    out.append(F.when(ones > 0, digit(ones)))
    return F.when(n.between(1, 9999), F.concat(*[F.coalesce(o, F.lit("")) for o in out])).otherwise(n.cast("string"))


def counter(n: Column, style: str | Column) -> Column:
    """A counter's value in a list style; the style may be a column. Unknown styles are decimal."""
    plain = n.cast("string")
    informal, formal = chinese(n, CJK_DIGITS), chinese(n, CJK_FORMAL)
    letters, numerals = F.when(n > 0, alpha(n)).otherwise(plain), F.when(n > 0, roman(n)).otherwise(plain)
    syllable = F.when(n.between(1, len(KATAKANA)), F.substring(F.lit(KATAKANA), n.cast("int"), F.lit(1))).otherwise(plain)
    made = {
        "none": F.lit(""), "disc": F.lit("•"), "circle": F.lit("◦"), "square": F.lit("▪"),
        "decimal-leading-zero": F.when(n.between(0, 9), F.concat(F.lit("0"), plain)).otherwise(plain),
        "lower-alpha": letters, "lower-latin": letters, "upper-alpha": F.upper(letters), "upper-latin": F.upper(letters),
        "lower-roman": numerals, "upper-roman": F.upper(numerals),
        "cjk-ideographic": informal, "simp-chinese-informal": informal, "trad-chinese-informal": informal, "japanese-informal": informal,
        "simp-chinese-formal": formal, "trad-chinese-formal": formal, "japanese-formal": formal,
        "cjk-decimal": F.when(n >= 0, cjk_decimal(n)).otherwise(plain), "katakana": syllable, "katakana-iroha": syllable,
    }
    if isinstance(style, str):
        return made.get(style, plain)
    chosen = F.when(style == "decimal", plain)
    for name, text in made.items():
        chosen = chosen.when(style == name, text)
    return chosen.otherwise(plain)


# Code page 1252 beyond Latin-1, from byte 0x80 on; a full stop stands where it has no character.
WIN_ANSI = "€.‚ƒ„…†‡ˆ‰Š‹Œ.Ž..‘’“”•–—˜™š›œ.žŸ"


NOT_WIN_ANSI = "[^\\x20-\\x7E\\xA0-\\xFF" + WIN_ANSI.replace(".", "") + "]"
# Characters that the code page lacks, and those that look like them.
LOOKALIKES = ("\u2007\u202f\u2009\u200a\u2010\u2011\u2212\u2032\u02bc\u2033", "    ---''\"")


def near_win_ansi(text: Column) -> Column:
    return F.translate(text, *LOOKALIKES)


def win_ansi_hex(text: Column) -> Column:
    """Bytes of code page 1252 as hexadecimal; null if a character has none."""
    chars = F.split(text, "")
    place = lambda c: F.instr(F.lit(WIN_ANSI), c)
    code = lambda c: F.when((place(c) > 0) & (c != "."), place(c) + 127).when(c.rlike("[\\x20-\\x7E\\xA0-\\xFF]"), F.ascii(c))
    codes = F.transform(F.filter(chars, lambda c: c != ""), code)
    return F.when(F.forall(codes, lambda n: n.isNotNull()), F.lower(F.array_join(F.transform(codes, lambda n: F.hex(n)), "")))
