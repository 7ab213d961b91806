"""What the lines of a page's Markdown are, judged from the page alone."""

from __future__ import annotations

import re

from .visual import consistent

BLANK, CODE, TABLE, HEADING, QUOTE, ITEM, PLAIN, FURNITURE = range(8)

_FIRST = {"": BLANK, "|": TABLE, ">": QUOTE, "#": HEADING} | dict.fromkeys("-*+0123456789", ITEM)
_LINK = r"!?\[[^\]]*\]\([^)]*\)"
_FENCE = re.compile(r"(`{3,}|~{3,})")
_HEADING = re.compile(r"#{1,6}(\s|$)")
_BOLD = re.compile(r"\*\*[^*]+\*\*")
_BULLET = re.compile(r"(?:[-*+]|\d{1,3}[.)])\s+")
_LINK_ITEM = re.compile(r"[-*+]\s+" + _LINK)
_LINK_ROW = re.compile(r"(?:" + _LINK + r"[\s·|•/,-]*)+")
_DIGIT = re.compile(r"\d")

# Words of the classic filler text.
FILLER_WORDS = frozenset(
    "lorem ipsum dolor amet consectetur adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua veniam nostrud "
    "exercitation ullamco laboris nisi aliquip commodo consequat aute irure reprehenderit voluptate velit cillum fugiat "
    "pariatur excepteur sint occaecat cupidatat proident culpa officia deserunt mollit laborum".split()
)
# Words without which hardly a sentence of a language is made.
FUNCTION_WORDS = frozenset(
    "the a an of and in to is was were for with on at by it that this from when which not as be are or "
    "der die das und ist von mit für den dem ein eine nicht auf im zu sich jede pro "
    "el la los las de que y en un una para con por no se lo su cada "
    "le les des et du une dans pour avec sur il qui ne chaque".split()
)
# Phrases of error messages, of demands for scripts or another browser, and of
# filler, that tell what a line is if it recurs widely; whole words, in lower case.
MESSAGE_PHRASES = (
    # English
    "error", "exception", "traceback", "failed", "failure", "denied", "forbidden", "unauthorized", "unavailable", "expired", "gone", "retired",
    "removed", "timeout", "timed out", "maintenance", "too many", "try again", "sorry", "oops", "permission", "not found", "not here",
    "not available", "can't find", "gateway", "no longer",
    "javascript", "script", "scripts", "scripting", "noscript", "browser", "captcha", "human", "loading", "just a moment", "cookies must",
    "sample", "placeholder", "dummy", "lorem", "ipsum", "filler", "insert", "goes here", "to follow", "click to", "headline", "subtitle",
    "section heading", "new page", "tbd", "asdf", "qwerty", "test",
    # German
    "fehler", "verweigert", "gesperrt", "nicht gefunden", "nicht verfügbar", "nicht erreichbar", "abgelaufen", "wartung", "erneut", "leider",
    "skripte", "browser",
    # French
    "erreur", "introuvable", "refusé", "interdit", "indisponible", "expiré", "n'existe plus", "réessayer", "désolé", "navigateur",
    # Spanish
    "no encontrada", "no encontrado", "denegado", "prohibido", "no disponible", "caducada", "caducado", "ya no existe", "mantenimiento",
    "inténtelo", "intentarlo", "lo sentimos", "navegador",
)
# Months, as they stand in dates.
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
    "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec",
    "januar", "februar", "märz", "mai", "juni", "juli", "oktober", "dezember", "okt", "dez",
    "janvier", "février", "mars", "avril", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre",
    "enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
)
# Placeholders of template languages.
PLACEHOLDER = re.compile(
    r"\{\{[\w\s.|\-]{1,60}\}\}|\{%-?[\w\s.=,\-]{1,60}-?%\}|<%[=-]?[\w\s.()\-]{1,60}%>|[$#]\{[\w\s.\-]{1,60}\}"
    r"|\[\[[\w\s.\-]{1,60}\]\](?!\()|%%\w{1,60}%%|(?<![\w_])__[A-Z][A-Z0-9_]*?__(?![\w_])|(?<![\w$])\$[A-Z][A-Z0-9_]*\$(?!\w)"
    r"|(?<![\w{$#\"])\{[A-Za-z][\w.]{0,60}\}(?!\})|\[(?:INSERT|ENTER|YOUR|ADD)\b[^\]\n]{0,60}\](?!\()|<[\w ]{1,60} goes here>"
)
# what a line must hold to be worth the search
_MARKS = ("{", "[[", "%%", "__", "<%", "$", " goes here>", "[INSERT", "[ENTER", "[YOUR", "[ADD")
_CODE_SPAN = re.compile(r"(`+)(?!`).*?(?<!`)\1(?!`)")
_WORD = re.compile(r"[^\W\d_]+")


def tidy(line: str) -> str:
    """Trimmed, with one space for each run of white space."""
    return " ".join(line.split())


def lines_of(markdown: str) -> list[str]:
    """The numbered lines of a text, tidied, in the consistent form of look-alikes."""
    return [tidy(x) for x in consistent(markdown).split("\n")]


def line_kinds(lines: list[str]) -> list[int]:
    """The kind of each tidied line. ``FURNITURE`` is what its form alone shows not to be
    content: rows and lists of links, menus, breadcrumbs, and blocks of related links with
    their heading. What a line says plays no part."""
    kinds = []
    fence = ""
    for line in lines:
        m = _FENCE.match(line) if line[:1] in ("`", "~") else None
        if not line:
            kinds.append(BLANK)
        elif fence:
            kinds.append(CODE)
            if m and m.group(1).startswith(fence) and not line[m.end() :].strip():
                fence = ""
        elif m:
            fence = m.group(1)
            kinds.append(CODE)
        else:
            kind = _FIRST.get(line[:1], PLAIN)
            if kind == HEADING and not _HEADING.match(line) or kind == ITEM and not _BULLET.match(line):
                kind = PLAIN
            kinds.append(kind)
    n = len(lines)
    k = 0
    while k < n:
        if kinds[k] == ITEM:
            end = k
            while end < n and kinds[end] == ITEM:
                end += 1
            block = lines[k:end]
            if all(_LINK_ITEM.fullmatch(x) for x in block):
                kinds[k:end] = [FURNITURE] * (end - k)
                before = k - 1
                while before >= 0 and kinds[before] == BLANK:
                    before -= 1
                if before >= 0 and (kinds[before] == HEADING and not lines[before].startswith("# ") or _BOLD.fullmatch(lines[before])):
                    kinds[before] = FURNITURE
            elif len(block) > 2 and all(_menu(_BULLET.sub("", x, count=1)) for x in block):
                kinds[k:end] = [FURNITURE] * (end - k)
            k = end
            continue
        if kinds[k] == PLAIN and _furniture(lines[k]):
            kinds[k] = FURNITURE
        k += 1
    return kinds


def _menu(x: str) -> bool:
    """A menu entry: a few words, no figures."""
    return len(x) <= 30 and x.count(" ") < 3 and not _DIGIT.search(x) and x[-1:] not in ".:;!?}>]$%"


def _furniture(line: str) -> bool:
    """A row of links, a menu in a row, or a breadcrumb."""
    if line[0] == "[" and _LINK_ROW.fullmatch(line):
        return True
    for mark in (" | ", " · ", " • "):
        if mark in line and all(_menu(x) for x in line.split(mark)):
            return True
    for mark in (" > ", " › ", " » ", " / "):
        if mark in line:
            parts = line.split(mark)
            if len(parts) > 2 and all(0 < len(x) <= 40 and x.count(" ") < 4 for x in parts) and line[-1] not in ".:?!":
                return True
    return False


#: Classes of a line for problem 1; ``TITLE`` is a heading with a phrase of messages.
NONE, MESSAGE, FILLER, TITLE = range(4)

_PHRASE = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(set(MESSAGE_PHRASES), key=len, reverse=True))) + r")(?!\w)")
# the longest word of each phrase, one of which a line must hold to be worth the search
_TELLING = frozenset(max(x.replace("'", " ").split(), key=len) for x in MESSAGE_PHRASES)
_STATUS = re.compile(r"(?:(?:http )?error |http )?[45]\d\d(?!\w)")
_PARTS = re.compile(r"\w+")


class _Telling(dict):
    """Word, as it stands between blanks, -> may it belong to a phrase?"""

    def __missing__(self, word: str) -> bool:
        if len(self) > 300_000:
            self.clear()
        told = self[word] = any(x in _TELLING or (x[:3] == "xxx" and not x.strip("x")) for x in _PARTS.findall(word))
        return told


_TOLD = _Telling()


def message_class(low: str, words: list[str]) -> int:
    """What a tidied line in lower case, split into ``words``, would be if it stood in place
    of a body and recurred widely."""
    if _STATUS.match(low.lstrip("#>*-+ ")):
        return MESSAGE
    told = any(map(_TOLD.__getitem__, words))
    if told and (_PHRASE.search(low.replace("’", "'")) or "xxx" in low):
        return FILLER if is_filler(low) else MESSAGE
    n = len(words)
    if n > 2 and 2 * len(set(words)) <= n + 1 and words[0][:1].isalpha():
        return MESSAGE  # the same few words over and over
    return FILLER if "dolor" in low and is_filler(low) else NONE


def is_filler(text: str) -> bool:
    """Filler in the manner of the classic Latin text: its words, and no sentence of a
    living language around them."""
    if not ("ipsum" in text or "lorem" in text or "dolor" in text):
        return False
    words = _WORD.findall(text)
    return sum(w in FILLER_WORDS for w in words) >= 2 and sum(w in FUNCTION_WORDS for w in words) <= len(words) // 20


def is_latin_prose(line: str) -> bool:
    """Could the line go on with filler that another line of its page is? Some words, none
    of them a function word of a living language, and no figures."""
    words = _WORD.findall(line.lower())
    return len(words) >= 5 and not _DIGIT.search(line) and not any(w in FUNCTION_WORDS for w in words)


def has_placeholder(lines: list[str], kinds: list[int]) -> bool:
    """Is there an unfilled placeholder outside code blocks and code spans?"""
    page = "\n".join(lines)
    marks = [x for x in _MARKS if x in page]
    if not marks:
        return False
    for line, kind in zip(lines, kinds):
        if kind != CODE and kind != BLANK and any(x in line for x in marks):
            if PLACEHOLDER.search(_CODE_SPAN.sub("", line) if "`" in line else line):
                return True
    return False
