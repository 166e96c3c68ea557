"""Styles of text: colours, case, scripts of characters, symbol fonts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NOT_WIN_ANSI

# Fonts of symbols, and what their characters, by the low byte of a private code point, stand for.
SYMBOL_FONT = "(?i)wingdings|webdings|symbol|zapf|dingbat"
WINGDINGS = {
    0x6C: "●", 0x6D: "○", 0x6E: "■", 0x6F: "□", 0x70: "◆", 0x71: "❖", 0x75: "◆", 0x76: "❖", 0x77: "◆", 0xA1: "○", 0xA2: "○", 0xA4: "◉", 0xA7: "▪", 0xA8: "□", 0xB2: "■", 0xB7: "•", 0xD8: "➢", 0xE0: "➔", 0xF0: "⇨", 0xFC: "✓", 0xFE: "☑",
}
SYMBOL = {0xA3: "≤", 0xA8: "◊", 0xAC: "←", 0xAE: "→", 0xB0: "°", 0xB1: "±", 0xB2: "■", 0xB3: "≥", 0xB7: "•", 0xB9: "≠", 0xBB: "≈"}
PLAIN_BULLET = "•"


def color(value: Column) -> Column:
    """struct(r, g, b), 0 to 1, of `rgb(...)` or `rgba(...)`; null for none, unreadable and all but transparent ones."""
    numbers = F.regexp_extract_all(value, F.lit(r"([0-9.]+%?)"), F.lit(1))
    plain = lambda s: F.regexp_replace(s, "%", "").try_cast("double")
    channel = lambda k: F.when(F.get(numbers, F.lit(k)).endswith("%"), plain(F.get(numbers, F.lit(k))) / 100).otherwise(plain(F.get(numbers, F.lit(k))) / 255)
    alpha = F.coalesce(plain(F.get(numbers, F.lit(3))), F.lit(1.0))
    return F.when((F.size(numbers) >= 3) & (alpha > F.lit(0.02)), F.struct(*[channel(k).alias(c) for k, c in enumerate("rgb")]))


def transformed(text: Column, mode: Column) -> Column:
    """Text in upper or lower case, or with each word's first letter in upper case; other modes leave it."""
    words = F.transform(F.split(text, r"(?<=\s)"), lambda w: F.when(w.rlike(r"\A\p{L}"), F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w)))).otherwise(w))
    return F.when(mode == "uppercase", F.upper(text)).when(mode == "lowercase", F.lower(text)).when(mode == "capitalize", F.array_join(words, "")).otherwise(text)


def char_class(char: Column) -> Column:
    """How a character is set: `latin` (in code page 1252), `cjk` (in no other way), `skip` (not at all)."""
    skipped = char.rlike(r"\A[\x00-\x1F\x7F-\x9F\x{200B}-\x{200D}\x{FEFF}]")
    return F.when(skipped, "skip").when(char.rlike(r"\A" + NOT_WIN_ANSI), "cjk").otherwise("latin")


def is_symbol_font(font: Column) -> Column:
    return F.coalesce(font.rlike(SYMBOL_FONT), F.lit(False))


def symbol_text(font: Column, text: Column) -> Column:
    """Private characters of symbol fonts as usual symbols: by the font's own table, else the other's, else a bullet."""

    def by(tables: tuple[dict[int, str], dict[int, str]]) -> Column:
        known = tables[1] | tables[0]
        # a font may have its characters at the start of the private area or at its last block
        pairs = {chr(base + k): v for base in (0xF000, 0xE000) for k, v in known.items()}
        return F.regexp_replace(F.translate(text, "".join(pairs), "".join(pairs.values())), r"[\x{E000}-\x{F8FF}]", PLAIN_BULLET)

    symbol = font.rlike("(?i)symbol") & ~font.rlike("(?i)wingdings")
    return F.when(symbol, by((SYMBOL, WINGDINGS))).otherwise(by((WINGDINGS, SYMBOL)))
