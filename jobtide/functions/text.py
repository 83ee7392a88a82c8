"""Text column functions: folding, whole-word terms, entities and HTML.

Everything here is a native expression, so it runs inside the scan's stage and
needs no shuffle. Literals are folded once on the driver with the same rules.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import NUMBER_WORDS

# Characters that fold to an ASCII dash, quote or space.
DASHES = "‐‑‒–—―−"
QUOTES = "‘’‛′"
DOUBLE_QUOTES = "“”″"
SPACE_CLASS = "\\s\\u00a0\\u1680\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
WIDE_SPACES = "\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200c))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable."""
    return F.transform(F.array(value), body)[0]


def running_sums(numbers: Column, block: int = 64) -> Column:
    """For each number of an array the sum of those before it. Blocks are summed first, so long arrays stay cheap."""
    def total(c: Column) -> Column:
        return F.aggregate(c, F.lit(0), lambda a, x: a + x)

    def sums(n: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / block).cast("int")), lambda b: total(F.slice(n, b * block + 1, F.lit(block))))
        bases = F.aggregate(blocks, F.array(F.lit(0)), lambda a, s: F.array_append(a, F.element_at(a, -1) + s))

        def at(base: Column) -> Column:
            def before(_, i: Column) -> Column:
                b = F.floor(i / block).cast("int")
                return F.get(base, b) + total(F.slice(n, b * block + 1, i - b * block))

            return F.transform(n, before)

        return let(bases, at)

    return let(numbers, sums)


def _strip_marks(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not "̀" <= c <= "ͯ")


@lru_cache(maxsize=1)
def _translate_table() -> tuple[str, str]:
    """Precomposed letters and the base letter each one reduces to."""
    source, target = [], []
    for code in range(0x80, 0x10000):
        char = chr(code)
        if 0xD800 <= code <= 0xDFFF:
            continue
        base = _strip_marks(char)
        if base != char and len(base) == 1:
            source.append(char)
            target.append(base)
    for chars, base in ((DASHES, "-"), (QUOTES, "'"), (DOUBLE_QUOTES, '"')):
        source.extend(chars)
        target.extend(base * len(chars))
    return "".join(source), "".join(target)


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """``_translate_table`` with wide spaces to a blank before it and combining marks, which go, behind it."""
    source, target = _translate_table()
    marks = "".join(map(chr, range(0x300, 0x370)))
    return WIDE_SPACES + source + marks, " " * len(WIDE_SPACES) + target


def _ascii_base(c: Column) -> Column:
    """Dashes, quotes, wide spaces and accents to ASCII; pure-ASCII rows skip the table."""
    source, target = _fold_table()
    return F.when(F.length(c) != F.octet_length(c), F.translate(c, source, target)).otherwise(c)


# A class of many ranges is asked at every character, and slows the patterns after it as well; a single blank, the
# commonest space by far, is no match here, as it stays what it is.
SPACE_RUN = "[\\t-\\r][\\t-\\r ]*| [\\t-\\r ]+"
BLANK_RUN = "[\\t\\x0b\\f][\\t\\x0b\\f ]*| [\\t\\x0b\\f ]+"


def fold(c: Column) -> Column:
    """Lower-case ASCII form with single spaces; '' for NULL."""
    return F.lower(F.trim(F.regexp_replace(_ascii_base(F.coalesce(c, F.lit(""))), SPACE_RUN, " ")))


def fold_lines(c: Column) -> Column:
    """``fold`` with line breaks kept: at most one blank line, none at the ends."""
    def where(needed, pattern: str, by: str):
        return lambda t: F.when(needed(t), F.regexp_replace(t, pattern, by)).otherwise(t)

    text = let(_ascii_base(F.coalesce(c, F.lit(""))), where(lambda t: t.contains("\r"), "\\r\\n?", "\n"))
    text = let(text, where(lambda t: t.contains("  ") | t.contains("\t") | t.contains("\x0b") | t.contains("\f"), BLANK_RUN, " "))
    text = let(text, where(lambda t: t.contains(" \n") | t.contains("\n "), " \\n ?|\\n ", "\n"))
    text = let(text, where(lambda t: t.contains("\n\n\n"), "\\n{3,}", "\n\n"))
    # The end of a pattern also lies before a last U+0085.
    return F.lower(let(text, lambda t: F.when(t.endswith("\u0085"), F.regexp_replace(t, "^[ \\n]+|[ \\n]+$", "")).otherwise(F.trim(t, F.lit(" \n")))))


def unlined(lines: Column, text: Column) -> Column:
    """``fold`` of a text from its ``fold_lines``, which spares a second folding. Lines hold no three breaks in a row."""
    one = F.replace(F.replace(lines, F.lit("\n\n"), F.lit("\n")), F.lit("\n"), F.lit(" "))
    return F.when(lines.endswith("\u0085"), fold(text)).otherwise(one)


def fold_literal(value: str | None) -> str:
    """``fold`` for a driver-side term."""
    if not isinstance(value, str):
        return ""
    source, target = _translate_table()
    text = _strip_marks(value.translate(str.maketrans(source, target)))
    return re.sub(r"[\s​﻿]+", " ", text).strip().lower()


def norm_text(c: Column) -> Column:
    """Single spaces, trimmed, lower case; accents stay. '' for NULL."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"[{SPACE_CLASS}&&[^\\u200b]]+", " ")))


def slugify_folded(c: Column) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(c, "['’]", ""), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def slugify(c: Column) -> Column:
    return slugify_folded(fold(c))


def title_case(c: Column) -> Column:
    """``acme-corp`` to ``Acme Corp``; letters after the first keep their case."""
    words = F.regexp_replace(F.regexp_replace(c, "[-_]+", " "), "\\s+", " ")
    # Split so every piece starts where an ASCII word starts.
    pieces = F.split(F.trim(words), "(?<![A-Za-z0-9_])(?=[a-z])")
    raised = F.transform(pieces, lambda p: F.when(p.rlike("^[a-z]"), F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, 2, 1 << 30))).otherwise(p))
    return F.array_join(raised, "")


WORD_LEFT = "(?<![a-z0-9])"


def _guards(folded: str) -> tuple[str, str]:
    """What may not stand left and right of a term; its edge characters decide."""
    word = re.compile("[a-z0-9]")
    left = WORD_LEFT if word.match(folded[0]) else "(?<![^\\s(,/|])"
    right = "(?![a-z0-9])" if word.match(folded[-1]) else "(?![^\\s),./|])"
    return left, right


def _escape(text: str) -> str:
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", text)


def term_pattern(term: str) -> str:
    """Whole-word pattern for one term."""
    folded = fold_literal(term)
    left, right = _guards(folded)
    return left + _escape(folded) + right


def folded_terms(terms) -> list[str]:
    """Distinct folded terms in the order given, blanks dropped."""
    return list(dict.fromkeys(t for t in (fold_literal(t) for t in terms or []) if t))


def terms_pattern(terms) -> str | None:
    """One alternation over all terms, the longest winning at any position; None when nothing is left.

    Terms are grouped by left guard and first character, so at most places in
    a text the matcher rejects all of them with one look to the left.
    """
    groups: dict[str, dict[str, list[str]]] = {}
    for term in sorted(folded_terms(terms), key=len, reverse=True):
        left, right = _guards(term)
        groups.setdefault(left, {}).setdefault(term[0], []).append(_escape(term[1:]) + right)
    if not groups:
        return None
    return "|".join(
        left + "(?:" + "|".join(f"{_escape(first)}(?:{'|'.join(rest)})" for first, rest in sorted(by_first.items())) + ")"
        for left, by_first in groups.items()
    )


def _tree(terms: list[str]) -> dict:
    """Terms by their characters; under '' a term's right guard."""
    root: dict = {}
    for term in terms:
        node = root
        for char in term:
            node = node.setdefault(char, {})
        node[""] = _guards(term)[1]
    return root


def _tree_pattern(node: dict) -> str:
    """The longest term of a tree. Four characters at most are tried in a row: more of them are halved by a look ahead."""
    def branch(chars: list[str]) -> list[str]:
        if len(chars) <= 4:
            return [_escape(c) + _tree_pattern(node[c]) for c in chars]
        half = len(chars) // 2
        return [f"(?=[{''.join(map(_escape_in_class, part))}])(?:{'|'.join(branch(part))})" for part in (chars[:half], chars[half:])]

    ways = branch(sorted(c for c in node if c)) + ([node[""]] if "" in node else [])
    return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"


def _escape_in_class(char: str) -> str:
    return char if char.isalnum() else "\\" + char


def terms_found(folded: Column, terms) -> Column:
    """Array of the matches of ``terms_pattern`` in reading order.

    Terms are asked only behind a character that no word has, which a match
    takes along, and by their characters, so that most words cost few looks.
    """
    wanted = folded_terms(terms)
    if not wanted:
        return F.array().cast("array<string>")
    if any(t[-1] in "(,/|" for t in wanted):  # such a term may end where the next begins, with nothing between to take along
        return F.regexp_extract_all(folded, F.lit(terms_pattern(wanted)), F.lit(0))
    groups: dict[str, list[str]] = {}
    for term in wanted:
        groups.setdefault(_guards(term)[0], []).append(term)
    pattern = "|".join(("" if left == WORD_LEFT else left) + _tree_pattern(_tree(some)) for left, some in groups.items())
    return F.regexp_extract_all(F.concat(F.lit(" "), folded), F.lit(f"[^a-z0-9]({pattern})"), F.lit(1))


def has_term(folded: Column, term: str) -> Column:
    return folded.rlike(term_pattern(term))


def any_term(folded: Column, terms) -> Column:
    pattern = terms_pattern(terms)
    return F.lit(False) if pattern is None else folded.rlike(pattern)


def all_terms(folded: Column, terms) -> Column:
    out = F.lit(True)
    for term in folded_terms(terms):
        out = out & has_term(folded, term)
    return out


def term_hits(folded: Column, terms) -> Column:
    """Array of the terms present, in the order asked."""
    wanted = folded_terms(terms)
    if not wanted:
        return F.array().cast("array<string>")
    return F.filter(F.array(*[F.when(has_term(folded, t), F.lit(t)) for t in wanted]), lambda x: x.isNotNull())


def parse_number_word(c: Column) -> Column:
    """``two`` or ``2.5`` to a double, NULL when neither."""
    token = F.lower(F.trim(c))
    words = F.create_map(*[x for w, n in NUMBER_WORDS.items() for x in (F.lit(w), F.lit(float(n)))])
    digits = F.nullif(F.regexp_extract(F.regexp_replace(token, ",", ""), "^[+-]?(?:\\d+\\.?\\d*|\\.\\d+)", 0), F.lit(""))
    return F.coalesce(words[token], digits.try_cast("double"))


# The named entities that are decoded. Any other name is left as written.
NAMED_ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ensp": " ",
    "emsp": " ", "thinsp": " ", "shy": "­", "ndash": "–", "mdash": "—",
    "horbar": "―", "minus": "−", "lsquo": "‘", "rsquo": "’", "sbquo": "‚", "ldquo": "“",
    "rdquo": "”", "bdquo": "„", "laquo": "«", "raquo": "»", "lsaquo": "‹", "rsaquo": "›",
    "hellip": "…", "bull": "•", "middot": "·", "sdot": "⋅", "dagger": "†", "Dagger": "‡",
    "copy": "©", "reg": "®", "trade": "™", "sect": "§", "para": "¶", "deg": "°", "permil": "‰",
    "euro": "€", "pound": "£", "yen": "¥", "cent": "¢", "curren": "¤", "plusmn": "±",
    "times": "×", "divide": "÷", "frac12": "½", "frac14": "¼", "frac34": "¾", "sup1": "¹",
    "sup2": "²", "sup3": "³", "micro": "µ", "ordm": "º", "ordf": "ª", "larr": "←", "rarr": "→",
    "harr": "↔", "uarr": "↑", "darr": "↓", "ne": "≠", "le": "≤", "ge": "≥", "asymp": "≈",
    "infin": "∞", "radic": "√", "check": "✓", "star": "☆", "hearts": "♥", "diams": "♦",
    "clubs": "♣", "spades": "♠", "eacute": "é", "egrave": "è", "ecirc": "ê", "agrave": "à",
    "acirc": "â", "ccedil": "ç", "uuml": "ü", "ouml": "ö", "auml": "ä", "szlig": "ß",
    "ntilde": "ñ", "aring": "å", "oslash": "ø", "aelig": "æ", "iacute": "í", "oacute": "ó",
    "uacute": "ú", "aacute": "á",
}
ENTITY_BODY = "&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});"


def _entity_map() -> Column:
    pairs = {"amp": "&", **NAMED_ENTITIES}
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _char_of_code(code: Column) -> Column:
    """Any Unicode scalar value as a string: its UTF-32 bytes decoded."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def decode_entities(c: Column) -> Column:
    """One pass over named and numeric entities; nothing is decoded twice.

    The text is cut at its entities, each entity is translated on its own and
    the pieces are glued back, so ``&amp;lt;`` becomes ``&lt;`` and stops there.
    """
    bodies = F.regexp_extract_all(c, F.lit(ENTITY_BODY), F.lit(1))
    between = F.split(c, ENTITY_BODY, -1)
    names = _entity_map()

    def char(body: Column) -> Column:
        hexadecimal = body.rlike("^#[xX]")
        code = F.when(hexadecimal, F.conv(F.substring(body, 3, 6), 16, 10)).otherwise(F.substring(body, 2, 7)).cast("int")
        valid = (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        numeric = F.when(body.startswith("#") & valid, _char_of_code(code))
        return F.coalesce(numeric, names[body], F.concat(F.lit("&"), body, F.lit(";")))

    glued = F.array_join(F.zip_with(between, bodies, lambda s, b: F.concat(s, F.coalesce(char(b), F.lit("")))), "")
    return F.when(c.rlike(ENTITY_BODY), glued).otherwise(c)


# How markup turns into line breaks.
VOID_BODIES = "(?is)<(script|style|head|noscript|svg|template)\\b[^>]*>.*?</\\1\\s*>"
SPENT_CLOSERS = "(?i)</\\s*(?:li|tr|dt|dd)\\s*>"
CELL_BREAK = "(?i)</?\\s*(?:td|th)\\b[^>]*>"
DOUBLE_BREAK = (
    "(?i)</?\\s*(?:p|div|ul|ol|dl|h[1-6]|blockquote|section|article|header|footer|pre|"
    "figcaption|table|thead|tbody)\\b[^>]*>"
)
SINGLE_BREAK = "(?i)<\\s*br\\s*/?\\s*>|<\\s*(?:li|tr|dt|dd)\\b[^>]*>"
TAGS = (
    "(?s)<!--.*?-->|<!\\[CDATA\\[.*?\\]\\]>|<!\\s*[a-zA-Z][^>]*>|"
    "</?\\s*[a-zA-Z][a-zA-Z0-9-]*(?:\\s[^>]*)?>"
)


def html_to_text(c: Column) -> Column:
    """Markup to plain text with paragraph and list breaks; '' for NULL."""
    text = F.coalesce(c, F.lit(""))
    for pattern, by in (
        (VOID_BODIES, " "), (SPENT_CLOSERS, ""), (CELL_BREAK, " "),
        (DOUBLE_BREAK, "\n\n"), (SINGLE_BREAK, "\n"), (TAGS, ""),
    ):
        text = F.regexp_replace(text, pattern, by)
    text = let(text, decode_entities)
    for pattern, by in (
        ("\\r\\n?", "\n"), (" ", " "), ("[ \\t\\f\\x0b]+", " "), (" *\\n *", "\n"), ("\\n{3,}", "\n\n"),
    ):
        text = F.regexp_replace(text, pattern, by)
    return trim_space(text)


def trim_space(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, f"^[{SPACE_CLASS}&&[^\\u200b]]+|[{SPACE_CLASS}&&[^\\u200b]]+$", "")


def trimmed(c: Column) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(trim_space(c), F.lit(""))
