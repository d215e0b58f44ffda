"""Template residue, filler, error pages and demands for scripts (problem 9).

Method: one pass of a multi-pattern automaton over a text finds phrases of error pages, filler and
script demands in several languages, words of filler and marks of log lines. A
document is excluded when the letters of the matched spans are a large part of all its letters,
page furniture aside; a mark of a log line covers its line once the line has that form. An unfilled
slot anywhere in the running text, which is told by its form, is enough by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from operator import eq

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pairloom.session import dealt_out

#: Least share of a document's letters and digits, furniture aside, in the matched spans. Texts that only mention such a thing
#: stay below 0.14 in the test tables.
MIN_COVER = 0.18
#: Least share of a stretch's words that are words of filler, for it to be filler.
FILLER_WORDS = 0.7

# Phrases, lower case, in the order error pages, script demands, filler.
ERROR_PHRASES = [
    "page not found", "file not found", "404 not found", "not found", "couldn't be loaded", "could not be loaded", "failed to load",
    "crashed unexpectedly", "not available at the moment", "currently unavailable", "temporarily unavailable", "service unavailable",
    "was removed by its owner", "has been removed", "has moved or never existed", "has been moved", "no longer exists", "no longer available",
    "doesn't exist", "does not exist", "didn't answer in time", "did not respond", "needs a permission you don't have",
    "you don't have permission", "sign in again", "log in again", "try again later", "please try again", "go back and check the address",
    "contact the team if this goes on", "contact the administrator", "oops", "something went wrong", "an error occurred", "an error has occurred",
    "unexpected error", "internal server error", "bad gateway", "gateway timeout", "gateway time-out", "bad request", "access denied",
    "permission denied", "forbidden", "unauthorized", "session has expired", "session expired", "too many requests", "upstream timed out",
    "request timed out", "connection refused", "connection reset", "connection timed out", "no such image", "no such file", "quota exceeded",
    "out of memory", "tried to allocate", "traceback (most recent call last)", "could not read shard", "giving up", "segmentation fault",
    "core dumped", "stack trace", "can't be shown", "cannot be shown", "can't be displayed", "cannot be displayed", "this site can't be reached", "fatal:", "uncaught exception", "nullpointerexception", "undefined", "caption service unavailable",
    "seite nicht gefunden", "konnte nicht geladen werden", "wurde entfernt", "existiert nicht", "nicht verfügbar", "nicht erreichbar",
    "bitte später erneut versuchen", "versuchen sie es später", "prüfen sie die adresse", "melden sie sich neu an", "hoppla",
    "gibt es nicht", "reagiert nicht", "ist ein fehler aufgetreten", "fehler aufgetreten", "zugriff verweigert", "antwortet nicht", "nicht rechtzeitig geantwortet", "abgestürzt",
    "page introuvable", "a été retirée", "a été retiré", "a été supprimée", "a été supprimé", "est indisponible", "n'a pas pu être",
    "n'existe plus", "n'existe pas", "n'a pas répondu", "ne répond pas", "veuillez réessayer", "réessayer plus tard", "vérifiez l'adresse", "reconnectez-vous",
    "oups", "une erreur", "accès refusé", "accès interdit",
    "página no encontrada", "fue retirada", "fue retirado", "fue eliminada", "fue eliminado", "ya no existe", "no existe", "no se pudo cargar",
    "no se ha podido", "no está disponible", "no responde", "vuelva a intentarlo", "inténtelo de nuevo", "compruebe la dirección",
    "inicie sesión de nuevo", "ups", "se produjo un error", "ha ocurrido un error", "acceso denegado",
    "pagina non trovata", "riprova più tardi", "accesso negato", "página não encontrada", "tente novamente", "acesso negado",
    "pagina niet gevonden", "probeer het later opnieuw", "toegang geweigerd", "страница не найдена", "попробуйте позже", "доступ запрещён",
]
SCRIPT_PHRASES = [
    "enable javascript", "enable js", "turn on js", "switch on js", "js is required", "turn on scripts", "switch on scripts", "activate scripts", "unblock scripts", "blocks scripts", "blocking scripts", "javascript is required", "javascript is disabled", "requires javascript", "turn on javascript", "switch on javascript",
    "activate javascript", "one with javascript", "without javascript", "javascript to continue", "scripts are disabled", "scripts are needed",
    "scripts are required", "enable scripts", "allow scripts", "scripts switched on", "without scripts enabled", "scripts enabled",
    "doesn't work properly in this browser", "doesn't work properly without", "your browser does not support", "browser is not supported",
    "unsupported browser", "update your browser", "change your browser settings", "enable cookies", "allow cookies", "accept cookies",
    "cookies must be on", "cookies are required", "cookies are disabled", "checking your browser", "securing the connection", "one moment",
    "please wait", "this takes a few seconds", "verifying that you are human", "verify you are human", "you are not a robot", "not a robot",
    "aktivieren sie javascript", "javascript aktivieren", "javascript ist erforderlich", "schalten sie skripte", "schalten sie javascript",
    "erlauben sie skripte", "blockiert skripte", "aktivieren sie skripte", "aktivieren sie cookies", "cookies aktivieren", "browser wird geprüft",
    "activez javascript", "activer javascript", "javascript est requis", "javascript est désactivé", "autorisez les scripts", "bloque les scripts",
    "activez les scripts", "autoriser les cookies", "activez les cookies", "vérification de votre navigateur",
    "active javascript", "activar javascript", "habilite javascript", "se requiere javascript", "javascript está desactivado",
    "permita los scripts", "bloquea los scripts", "active las cookies", "permita las cookies", "comprobando su navegador",
    "abilita javascript", "attiva javascript", "consenti gli script", "ative o javascript", "habilite o javascript", "permita os scripts",
    "schakel javascript in", "sta scripts toe", "включите javascript", "разрешите скрипты",
]
FILLER_PHRASES = [
    "lorem ipsum", "placeholder text", "to be replaced", "your description here", "your text here", "your caption here", "your title here",
    "your content here", "sample caption goes here", "sample text", "goes here", "insert content before publishing", "insert text here",
    "insert content", "type the edited caption", "enter text here", "write something here", "todo write caption", "todo write", "todo add",
    "coming soon", "under construction", "dummy text", "text text text", "content to follow", "description to follow",
    "hier steht ihr text", "ihr text hier", "platzhaltertext", "blindtext", "hier text einfügen", "text folgt",
    "texte à remplacer", "votre texte ici", "insérez votre texte", "texte de remplissage", "texte factice",
    "escriba aquí su texto", "su texto aquí", "texto de relleno", "texto de ejemplo", "inserte su texto", "texto de prueba",
    "il tuo testo qui", "seu texto aqui", "uw tekst hier", "ваш текст здесь",
]
#: Words of pseudo-Latin filler and of keyboard or test filler.
LATIN_FILLER = set(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis "
    "nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat "
    "nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim vitae augue vel porta felis turpis "
    "neque justo ligula quam massa erat vestibulum pellentesque mauris ut et in non id est laborum ante nunc arcu odio eget".split()
)
#: Those of them that are common words of living languages: they count in a stretch of filler, but don't make a text worth a closer look.
COMMON = {"in", "et", "non", "est", "ut", "id", "vel", "sed", "ante", "quam", "nulla", "erat", "enim", "massa"}
TEST_FILLER = set(
    "foo bar baz qux bla blah blabla test test2 tests testing tester asdf asdfgh asdfghjkl qwer qwert qwerty qwertz jkl xx xxx xxxx xxxxx "
    "123 1234 12345 abc abcd aaa bbb tbd tba todo tbc fixme dummy placeholder".split()
)

_NAME = r"[\w .\-]{1,60}"
_HTML = (
    r"html|head|body|div|span|p|br|hr|h[1-6]|b|i|u|s|a|em|strong|img|ul|ol|li|dl|dt|dd|table|tr|td|th|thead|tbody|form|input|button|label|select|"
    r"option|nav|main|section|article|header|footer|aside|script|noscript|style|link|meta|pre|code|svg|path|iframe|video|audio|figure|center|font|sup|sub|small"
)
SLOT = re.compile(
    r"(?=[{$#<%@_\[])(?:"
    r"\{\{\{?\s*[\w .\-|\[\]]{1,60}\s*\}\}"
    rf"|[$#]\{{\s*{_NAME}\s*\}}"
    r"|\{%[^%{}\n]{1,60}%\}"
    r"|<%[=\-]?[^%<>\n]{1,60}%>"
    r"|%\([\w .\-]{1,40}\)[sdfr]"
    r"|@@\w{2,40}@@"
    r"|__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__"
    r"|%[A-Z][A-Z0-9_]{1,38}%"
    r"|(?<![\\\w^}])\{[A-Za-z_]\w{1,40}\}"
    r"|\[\[\s*[A-Za-z_]\w{1,40}\s*\]\]"
    r"|<<\s*[A-Za-z_]\w{1,40}\s*>>"
    r"|\[(?![0-9A-F]{8,}\])[A-Z][A-Z0-9]{2,}(?:[_ \-][A-Z0-9]+)*\]"
    r"|\[(?i:your|insert|enter|add|type|write|fill in|put|placeholder|name of|ihr|ihre|hier|votre|insérer|insérez|su|tu|insertar|inserte|escriba)\b[^\[\]\n]{1,60}\]"
    rf"|<(?!/?(?:(?i:{_HTML}))\b)[A-Z][A-Z0-9]+(?:[_ ][A-Z0-9]+)*>"
    r"|<(?i:your|insert|enter|add|type|ihr|votre|insérer|insertar|inserte)\b[^<>\n=]{1,60}>"
    r")"
)
_CODE = re.compile(r"```.*?```|`[^`\n]*`", re.S)
_QUOTED_SLOT = re.compile(r"(?<![:=(,\[{]\s)(?<![:=(,\[{])[\"“„«]\s*(\S[^\"”“»\n]{0,60}\S)\s*[\"”“»]")
_QUOTE = re.compile(r"\"[^\"\n]{0,500}\"|“[^”\n]{0,500}”|„[^“”\n]{0,500}[“”]|«[^»\n]{0,500}»")
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_STRETCH = re.compile(r"[\n\r]+|(?<=[.!?…;])\s+")
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
_STATUS = re.compile(r"^\W*(?:(?:http(?:/\d(?:\.\d)?)?|error|fehler|erreur|status|code)\W*)*[1-5]\d\d\b(?=\W|$)")
_BARE_STATUS = re.compile(r"(?:^|[\n\r.!?…;>])\W{0,20}[1-5]\d\d\b")
_REFERENCE = re.compile(r"\s{0,20}(?:\[[^\]\n]{1,40}\]\s{0,20})+")
_LOG = re.compile(r"^\W{0,200}(?:\[[^\]\n]{0,60}\]\s{0,20}){0,5}(?:warn(?:ing)?|error|fatal|critical|panic|exception)\b|\b[\w.]{0,80}(?:error|exception)(?::| at\b| in\b)|^\s*file \"[^\"]+\", line \d+|^\s*null\W*$|^\s*nan\W*$|errno \d+")
_JAVA = re.compile(r"java[ -]script")
_HTML_ERROR = re.compile(r"<title>\s*(?:error\s*)?[1-5]\d\d\b[^<]*</title>")
_JSON_ERROR = re.compile(r"^\W*(?:\[[^\]]*\]\s*)?\{\s*\"(?:error|errors|fault|exception)\"\s*:")
_ID = re.compile(r"^\W*(?:(?:ref|id|ray id|request id|trace|wait|reference|code)\b\W*)?[\w\-.]*\d[\w\-.]*(?:\s*s(?:econds)?)?\W*$")


#: Marks that may begin or stand in a log line, a status line or an error as JSON or HTML.
LOG_MARKS = ["error", "exception", "warn", "fatal", "critical", "panic", "errno", "file \"", "null", "nan", "fault", "<title>", "http", "fehler", "erreur", "status", "code"]


@lru_cache(maxsize=1)
def _automaton():
    """All patterns by their last characters: length, kind, and whether it is a whole phrase, a word of filler or only a mark."""
    import ahocorasick

    found = ahocorasick.Automaton()
    marks = [(m, "error", "mark") for m in LOG_MARKS]
    words_ = [(w, "filler", "word") for w in sorted(LATIN_FILLER | TEST_FILLER)]
    phrases = [(p, kind, "phrase") for kind, all_ in (("filler", FILLER_PHRASES), ("script", SCRIPT_PHRASES), ("error", ERROR_PHRASES)) for p in all_]
    patterns: dict[str, list[tuple[int, str, str]]] = {}
    for text, kind, way in marks + words_ + phrases:
        patterns.setdefault(text, []).append((len(text), kind, way))
    for text, meanings in patterns.items():
        found.add_word(text, meanings)
    found.make_automaton()
    return found


def has_slot(text: str) -> bool:
    """Whether an unfilled slot stands in the running text, outside code and not as a quotation by itself."""
    if SLOT.search(text) is None:
        return False
    if "`" in text:
        text = _CODE.sub(" ", text)
    text = _QUOTED_SLOT.sub(lambda m: " " if SLOT.fullmatch(m[1]) else m[0], text)
    for m in SLOT.finditer(text):
        tag = re.fullmatch(r"<([A-Z]+)>", m[0])
        if tag is None or re.search(rf"</{tag[1]}>", text, re.I) is None:
            return True
    return False


def _hits(low: str) -> Iterator[tuple[int, int, str, str]]:
    """Start, end, kind and way of each pattern in a text; phrases and words only where they begin and end at word ends."""
    for last, meanings in _automaton().iter(low):
        for size, kind, way in meanings:
            start, end = last - size + 1, last + 1
            whole = not (start and low[start - 1].isalnum() and low[start].isalnum()) and not (end < len(low) and low[end].isalnum() and low[last].isalnum())
            if whole or way == "mark":
                yield start, end, kind, way


def _repeats(words: list[str]) -> bool:
    """One phrase of up to five words over and over."""
    return len(words) >= 4 and any(len(words) >= 3 * n and words[n:] == words[:-n] for n in range(1, 6))


def _letters(text: str) -> int:
    return sum(map(len, _WORD.findall(text)))


def _error_line(stretch: str, words: int) -> bool:
    """Whether a stretch has the form of a log line or a bare status, quotations aside for the latter."""
    bare = _QUOTE.sub(" ", stretch) if "line " not in stretch else stretch
    return _LOG.search(stretch) is not None or (words <= 8 and _STATUS.search(bare) is not None)


def coverage(text: str) -> tuple[float, str | None]:
    """The share of a text's letters in matched spans, page furniture aside, and the kind that covers most. Slots don't count."""
    low = _JAVA.sub("javascript", text.lower().replace("’", "'").replace("\u00a0", " "))
    words = _WORD.findall(low)
    if _repeats(words):
        return 1.0, "filler"
    hits = list(_hits(low))
    # Without any of these no stretch is covered: a pattern, a run of words that come again after the same distance, or a bare status.
    if not (
        any(h[3] != "word" or low[h[0] : h[1]] not in COMMON for h in hits)
        or any(b"\1" * max(3, 2 * n) in bytes(map(eq, words[n:], words)) for n in range(1, 6))
        or _BARE_STATUS.search(low)
        or sum(h[3] == "word" for h in hits) >= 4 and any(w in COMMON and v in COMMON for w, v in zip(words, words[1:]))
    ):
        return 0.0, None
    if _JSON_ERROR.search(low) or _HTML_ERROR.search(low):
        marks = _HTML_ERROR.search(low) or low
        return (1.0 if marks is low else (_letters(low) and min(1.0, 3 * _letters(marks[0]) / _letters(_TAG.sub("\n", low)))), "error")
    hits.sort()
    whole = 0
    covered: dict[str, int] = {}
    at, lo = 0, 0
    masked = _TAG.sub(lambda m: "\n" * len(m[0]), low)
    for stretch_at, end in _stretches(masked):
        stretch = masked[stretch_at:end]
        own = _WORD.findall(stretch)
        size = sum(map(len, own))
        if reference := _REFERENCE.match(stretch):  # identifiers before a message are no part of it
            size = max(0, size - _letters(reference[0])) or size
        while lo < len(hits) and hits[lo][0] < stretch_at:
            lo += 1
        if not size:
            continue
        inside = []
        at = lo
        while at < len(hits) and hits[at][0] < end:
            if hits[at][1] <= end:
                inside.append(hits[at])
            at += 1
        filler = sum(h[3] == "word" for h in inside)
        if _repeats(own) or (filler >= FILLER_WORDS * len(own) and (len(own) >= 4 or any(w in TEST_FILLER for w in own))):
            covered["filler"] = covered.get("filler", 0) + size
        elif (own[0][:1].isdigit() or any(h[3] == "mark" for h in inside)) and _error_line(stretch, len(own)):
            covered["error"] = covered.get("error", 0) + size
        elif spans := [h for h in inside if h[3] == "phrase"]:
            quoted = [m.span() for m in _QUOTE.finditer(stretch)] if "line " not in stretch else []
            matched, to = 0, 0
            kinds: dict[str, int] = {}
            for start, stop, kind, _ in spans:
                if any(a <= start - stretch_at and stop - stretch_at <= b for a, b in quoted):
                    continue
                n = _letters(masked[max(start, to) : stop]) if stop > to else 0
                matched, to = matched + n, max(to, stop)
                kinds[kind] = kinds.get(kind, 0) + n
            for kind, n in kinds.items():
                covered[kind] = covered.get(kind, 0) + n
            if not matched and _furniture(stretch, own):
                continue
        elif _furniture(stretch, own):
            continue
        whole += size
    most = max(sorted(covered), key=covered.get) if covered else None
    return (sum(covered.values()) / whole if whole else 0.0), most


def _stretches(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in _STRETCH.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def residue_kind(text: str | None) -> str | None:
    """``slot``, ``error``, ``script`` or ``filler`` if a text is residue, else null. A null or blank text isn't."""
    if not text or not text.strip():
        return None
    if has_slot(text):
        return "slot"
    share, kind = coverage(text)
    return kind if share >= MIN_COVER else None


def _furniture(stretch: str, own: list[str]) -> bool:
    """Navigation, short headings, marks and references around a page's content."""
    if _ID.match(stretch):
        return True
    if len(own) <= 4 and not re.search(r"[.!?]\s*$|^\s*[-*]?\s*\w+\s*:", stretch):
        return True
    parts = [p for p in re.split(r"\s[|·•>»/–-]\s|\||·|•", stretch) if p.strip()]
    return len(parts) >= 3 and all(len(_WORD.findall(p)) <= 3 for p in parts)


def flag_residue(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, kind)`` of the documents that are residue. Other columns don't matter; each text is judged whole, by itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kinds = pd.Series([residue_kind(x) for x in b[text]], dtype=object)
            hit = kinds.notna().to_numpy()
            yield pd.DataFrame({key: b[key][hit], "kind": kinds[hit].to_numpy()})

    kind = docs.schema[key].dataType.simpleString()
    return dealt_out(docs.filter(F.col(text).isNotNull()).select(key, text)).mapInPandas(run, f"{key} {kind}, kind string")
