"""Defects of answers to edit instructions (problem 3).

Method: openings of answers that share hardly a word with their prompt are clustered by the rarest
of their words, an exact bottom-k sketch; links of verified similarity join clusters transitively. A cluster is judged as a
whole: a template that recurs across unrelated prompts is a refusal if its texts mostly speak in
the first person or negate, and one that is too rare to recur if they say in so many words that
they decline. A refusal is an answer with an opening in such a cluster, and nothing else; the
wordings are only a feature of the clusters. Emptiness, language, termination and copy checks
label the remaining defects, each answer by itself.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.components import components
from pairloom.operators.skew import pair_join, spread_join
from pairloom.session import dealt_out, materialize

#: Words of an answer's openings: a template may go on in free words after a short one, and only a longer one may differ in a word.
OPENINGS = (8, 12, 24)
#: Words of a brief opening, which tells a template only by the explicit wordings that go on from it.
BRIEF = 3
#: Least similarity, as word sets, of two openings that are linked: of 9 words one may be replaced, of 4 one may be put in.
SIMILARITY = 0.8
#: Rarest common words that two openings meet by. Sets with fewer words than these are linked with equal ones only, as they are at any similarity over 2/3.
KEY_WORDS = 3
#: Pairs per row up to which the buckets' pairs are all compared at once; beyond, most are spared by clusters found before.
PAIRS_A_ROW = 64
#: Members of a bucket that its members are compared with to find those clusters. They save work only; all pairs of different clusters follow.
CENTRES = 16
#: What is known of an opening beside its words: three sketches of independent hashes, by which few pairs have to be counted in vain.
SKETCHES = ("sketch0", "sketch1", "sketch2")
ROW = ("id", "opening", "size", *SKETCHES)
#: Stands in an opening for a word of the prompt that isn't a function word.
SLOT = "_"
#: An opening is foreign to its prompt if it shares no more than this part of its words with it.
SHARED = 0.34
#: Unrelated prompts in which a template recurs at least.
MIN_PROMPTS = 3
#: What an opening is of: a caption or a phrase, as kinds that aren't linked with each other, and brief ones as two more.
CAPTION, PHRASE, AND_BRIEF = 0, 1, 2

# Wordings by which an answer declines, lower case, in any text that isn't quoted.
STRONG = re.compile(
    r"\b(?:sorry(?!-)|apologi[sz]e|apologies|regret(?:tably|fully)?|unfortunately|i(?:'m| am) afraid|unable to|not able to|refus(?:e|ed|al|ing)|declin(?:e|ed|ing)\b|"
    r"(?:i |we )?(?:can't|cannot|can not|could not|couldn't|won't|will not|would not|wouldn't|must not|may not|shouldn't) (?:do|be|help|assist|edit|change|alter|comply|produce|provide|"
    r"create|make|fulfil+|generate|modify|complete|process|answer|continue|suggest|propose|offer|support|engage|say|see|view|perform|give|write|share|proceed|carry)|"
    r"language model|as an ai\b|ai assistant|against (?:my|the|our) (?:rules|guidelines|policy|policies|principles)|(?:not|isn't|is not) (?:something|anything) (?:i|we)\b|(?:not|isn't) possible (?:to|for)|(?:do not|don't) have enough|let me know if i can|give me another|thanks for asking|no (?:\w+ )?(?:edits?|changes?|modifications?)\b|"
    r"nothing (?:suitable|here|(?:\w+ )?to (?:change|edit|alter|modify))|(?:i'd|would) rather not|(?:i'm|am) not going to|insufficient (?:information|context|detail)|cannot (?:determine|identify|tell)|beyond (?:my|what i)|(?:my|our|content|safety) (?:guidelines|polic(?:y|ies)|rules)|i (?:do not|don't) (?:think|feel|believe|want|see|know|have)|no single thing|not enough information|cannot edit|can't edit|unsafe|not (?:allowed|permitted|comfortable|appropriate)|request (?:denied|rejected|blocked)|"
    r"es tut mir leid|tut mir leid|entschuldig(?:ung|en)|bedaure|leider|kann ich (?:nicht|keine)|ich kann (?:\w+ ){0,4}(?:nicht|keine)|nicht möglich|als sprachmodell|geht das nicht|"
    r"désolée?|navrée?|je regrette|malheureusement|je ne peux|je ne suis pas|je ne saurais|impossible de|en tant que modèle|n'est (?:pas )?possible|modification n'est|"
    r"lo siento|lamentablemente|lamento|perdón|disculp[ae]|no puedo|no me es posible|no es posible|imposible|como modelo de lenguaje|desafortunadamente|"
    r"mi dispiace|purtroppo|non posso|desculpe|infelizmente|não posso|het spijt me|helaas|извините|простите|к сожалению|не могу|не можу)\b"
)
# What a caption never says of its scene, but an answer that speaks of itself or of its task does.
OF_ITSELF = re.compile(
    r"\bi(?:'m|'d|'ve|'ll| am| can| could| do| don| have| must| will| won| would| cannot| may| might| should| prefer| think| refuse| decline| regret)\b|"
    r"\b(?:ich|je|j'ai|j'aime|yo|puedo|debo|prefiero|quiero|posso|preferisco|prefiro)\b|"
    r"\b(?:captions?|edits?|editing|requests?|instructions?|polic(?:y|ies)|guidelines?|out of scope|bildunterschrift|bildbeschreibung|anfrage|bearbeit\w*|änder(?:n|ung|ungen)|légende|demande|"
    r"modif(?:ier|ication|ications)|descripción|leyenda|solicitud|edición|editar|modificar|didascalia|legenda|запрос|описани\w+|подпис\w+)\b"
)
# Words of the first person and of negation.
WEAK = re.compile(
    r"\b(?:i|i'm|i've|i'd|me|my|can't|cannot|won't|don't|isn't|doesn't|not|no|nothing|none|never|"
    r"ich|mir|mein\w*|nicht|kein\w*|nichts|je|j'ai|moi|mon|ne|n'est|pas|aucune?|rien|no|yo|nada|ningun[ao]?|"
    r"non|não|niet|geen|я|не|нет)\b"
)
#: Written stand-ins for no value, reduced to letters and digits.
STAND_INS = set(
    "null nil none na nan nada empty void undefined unknown missing blank notavailable notapplicable noanswer novalue nothing nichts keine keiner leer "
    "keineangabe ka vide aucun aucune néant rien so vacío vacio ninguno ninguna sd nulo nulle tbd todo nullnull nonenone noresponse nooutput emptystring пусто нет".split()
)
# Frequent short words by language.
FUNCTION_WORDS = {
    "en": "a an the of in on at to with and is are there this that one close during under over behind near next beside below above from by stands its his her for while before left right front shortly late evening night day",
    "de": "der die das dem den des ein eine einen einem einer eines und im am auf in bei mit vor hinter neben unter über zu zum zur ist sich kurz spät an unter aus vom von für nach",
    "fr": "le la les l un une des du de d et est dans sur sous avec au aux à près derrière devant côté pendant par ce cette ces tard dans peu avant qui pour en",
    "es": "el la los las un una unos unas y de del en con al a junto detrás delante debajo cerca durante por sobre muy tarde poco antes es está que para su",
    "it": "il lo la gli le un uno una e di del della nel nella con al alla sul sulla sotto sopra vicino dietro davanti durante per è che tardi poco prima",
    "pt": "o a os as um uma e de do da no na nos nas com ao à sob sobre perto atrás frente durante por para é que muito tarde antes pela pelo",
    "nl": "de het een en van in op met voor achter naast onder boven bij aan is er die dat tijdens kort laat aan uit naar",
    "pl": "i w na z ze do pod nad przed za obok przy jest się po o od dla podczas późno tuż",
    "sv": "en ett och i på med vid under över bakom framför bredvid är den det som till av för sent strax",
}
_LANG_OF: dict[str, list[str]] = {}
for _lang, _list in FUNCTION_WORDS.items():
    for _w in set(_list.split()):
        _LANG_OF.setdefault(_w, []).append(_lang)
#: Words after which no caption ends: articles, prepositions, conjunctions and auxiliaries of the four languages of captions.
OPEN_ENDED = set(
    "a an the of in on at to with and or is are this that one during under over behind near beside below above from by its his her for while before as "
    "der die das dem den des ein eine einen einem einer und im am auf bei mit vor hinter neben unter über zu zum zur ist kurz an aus von "
    "le la les un une des du de et est dans sur sous avec au aux à près par ce cette pendant "
    "el los las una unos unas y del en con al junto por sobre muy es está".split()
)

_WORD = re.compile(r"[^\W_]+")
_QUOTES = re.compile(r"\"[^\"]{0,2000}\"|“[^”]{0,2000}”|„[^“”]{0,2000}[“”]|«[^»]{0,2000}»|‘[^’]{0,2000}’(?!\w)|(?<!\w)'[^'\n]{2,200}'(?!\w)")
_END_MARKS = " \t\r\n   ​\"'”’»)]*_}-–—:;,"
_LABEL = re.compile(r"^[\W_]*(?:[^\W_][\w \t-]{0,30}?)\s*(?:[:：=]|->|=>|-)\s*")


def _tokens(text: str) -> list[str]:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(text.casefold())


def _canon(text: str) -> str:
    return "".join(_tokens(text))


def _unquoted(text: str) -> str:
    """A text without the quotations in it; a text that is one quotation as a whole keeps its words."""
    bare = _QUOTES.sub(" ", text)
    return bare if _WORD.search(bare) else text


def is_empty(text: str | None) -> bool:
    """Null, no letter or digit, or a mere stand-in for no value."""
    if text is None:
        return True
    c = _canon(text)
    return not c or c in STAND_INS


def script(text: str) -> str:
    """The most frequent script of a text's letters: latin, or the first word of their Unicode names."""
    counts: dict[str, int] = {}
    for c in text:
        if c.isalpha():
            name = "latin" if c < "ɐ" else _script(c)
            counts[name] = counts.get(name, 0) + 1
    return max(counts, key=counts.get) if counts else ""


@lru_cache(maxsize=4096)
def _script(c: str) -> str:
    return unicodedata.name(c, "?").split(" ")[0].lower()


def languages(tokens: list[str]) -> set[str]:
    """The languages with most function words among the tokens; several if they tie, none without any."""
    hits: dict[str, int] = {}
    for t in tokens:
        for lang in _LANG_OF.get(t, ()):
            hits[lang] = hits.get(lang, 0) + 1
    most = max(hits.values(), default=0)
    return {lang for lang, n in hits.items() if n == most}


def other_language(prompt: str, answer: str) -> bool:
    """Whether an answer is in another language than its prompt, quotations aside.

    Another script is another language. Otherwise the languages told by function words must
    differ, and the answer may share only a minority of its words with the prompt, as an edit in
    the prompt's own language shares most of them.
    """
    a, b = _unquoted(prompt), _unquoted(answer)
    sa, sb = script(a), script(b)
    if sa and sb and sa != sb:
        return True
    ta, tb = _tokens(a), _tokens(b)
    if not ta or len(tb) < 2:
        return False
    known = set(ta)
    shared = sum(t in known for t in tb) / len(tb)
    if shared > 0.5:
        return False
    la, lb = languages(ta), languages(tb)
    if la and lb:
        return not la & lb
    return bool(la) and shared <= 0.1 and len(tb) >= 5


def _aligned_end(expected: list[str], got: list[str]) -> bool:
    """Whether a text stops inside another: its last word, or the beginning of one, follows there the word it follows here, and more comes after."""
    last = got[-1]
    before = got[-2] if len(got) > 1 else None
    for i, w in enumerate(expected[:-1] if last == expected[-1] else expected):
        if w.startswith(last) and (w != last or i < len(expected) - 1) and (before is None or i == 0 or expected[i - 1] == before):
            return True
    return False


def truncated(prompt: str, selected: str | None, phrase: str | None, answer: str) -> bool:
    """Whether a caption breaks off before its sentence is complete.

    A caption that ends as its prompt does, or as the prompt with the phrase put in, is complete
    with or without a full stop. One that ends earlier is complete if it has the final mark of a
    sentence; an ellipsis is none. Without a mark it is cut off if its last word is one that no
    caption ends with, a fragment, or a place inside the prompt after which more must come.
    """
    label = _LABEL.match(answer)
    got, want = _tokens(answer), _tokens(prompt)
    if label and got[: len(_tokens(label[0]))] and _tokens(label[0]) != want[: len(_tokens(label[0]))]:
        got = got[len(_tokens(label[0])) :] or got
    if not got or not want:
        return False
    put, sel = _tokens(phrase or ""), _tokens(selected or "")
    if got[-1] == want[-1] and len(got) > 1:
        return got[-1] in OPEN_ENDED and len(got) < 0.7 * len(want)
    bare = answer.rstrip(_END_MARKS)
    if put and got[-len(put) :] == put and sel and want[-len(sel) :] == sel:
        return False
    whole, tail = _canon(prompt), _canon(answer)[-8:]
    if whole.endswith(tail):
        return False
    if not bare.endswith(("...", "…", "..")) and bare[-1:] in ".!?。！？｡":
        return False
    if got[-1] in OPEN_ENDED:
        return True
    if (len(tail) == 8 and tail in whole) or _aligned_end(want, got) or (len(put) > 1 and _aligned_end(put, got)):
        return True
    every = {*want, *put}
    if got[-1] not in every and any(w.startswith(got[-1]) for w in every):
        return True
    # It stops after the new phrase, which follows the word that the old one follows in the prompt.
    if put and got[-len(put) :] == put and len(got) > len(put) and sel and _follows(want, sel) == got[-len(put) - 1]:
        return True
    return bare.endswith(("...", "…", ".."))


def _follows(words_: list[str], part: list[str]) -> str | None:
    n = len(part)
    return next((words_[i - 1] for i in range(1, len(words_) - n + 1) if words_[i + n - 1] == part[-1] and words_[i : i + n][-1:] == part[-1:] and words_[i + n - 2 : i + n] == part[-2:]), None)


def copied(prompt: str, answer: str) -> bool:
    """Whether an answer is the prompt again, but for formatting and a leading label on either."""
    a, b = _canon(prompt), _canon(answer)
    if not a or not b:
        return False
    if a == b:
        return True
    sa, sb = _canon(_LABEL.sub("", prompt, count=1)), _canon(_LABEL.sub("", answer, count=1))
    return bool(a) and (sb == a or (sa and (sa == b or sa == sb) and len(sa) > 0.5 * len(a)))


def declines(text: str | None, prompt: str | None) -> bool:
    """Whether a text declines by its own wording, outside quotations and behind a label.

    It does so by a known wording while it shares at most three fifths of its words with the
    prompt, or by speaking of itself or its task while it shares hardly any.
    """
    if not text:
        return False
    low = _unquoted(text).lower().replace("’", "'").replace("_", " ")
    strong = STRONG.search(low) is not None
    if not strong and OF_ITSELF.search(_LABEL.sub("", low, count=1) or low) is None:
        return False
    own = _tokens(low)
    known = set(_tokens(prompt or ""))
    shared = sum(t in known for t in own)
    return shared <= 0.6 * len(own) if strong else len(own) > 2 and shared <= SHARED * len(own)


def weak_cue(text: str, phrase: bool) -> bool:
    """Whether a text speaks in the first person or negates; a phrase, which may negate its object, must do so twice."""
    low = _unquoted(text).lower().replace("’", "'").replace("_", " ")
    return STRONG.search(low) is not None or len(WEAK.findall(low)) >= (2 if phrase else 1)


def _keyed(openings: DataFrame) -> DataFrame:
    """The openings, a row for each key that may lead to a similar one: ``ROW``, kind, key.

    Words are in one order for all, rare ones first. Of two sets with ``SIMILARITY`` the first
    ``KEY_WORDS`` common words stand in either among as many words more as that set may lack in the other, so
    the combinations of ``KEY_WORDS`` words from there miss no pair. A sketch has a bit for the parity
    of the words of a hash: two sketches differ in no more bits than the sets in words.
    """
    words_of = F.array_distinct(F.split("opening", " "))
    sketches = [F.expr(f"aggregate(set, 0L, (s, w) -> s ^ shiftleft(1L, cast(pmod(xxhash64({k}, w), 64) as int)))").alias(name) for k, name in enumerate(SKETCHES)]
    sets = openings.select(F.monotonically_increasing_id().alias("id"), "opening", "kind", words_of.alias("set"))
    sets = materialize(sets.select("*", F.size("set").alias("size"), *sketches), "sets")
    words = sets.select("id", F.explode("set").alias("word"))
    ranked = spread_join(words, words.groupBy("word").agg(F.count("*").alias("n")), ["word"])
    ranked = ranked.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("ranked"))  # one opening's words
    first = F.slice(F.col("ranked.word"), F.lit(1), F.col("size") - F.ceil(SIMILARITY * F.col("size") - 1e-9).cast("int") + KEY_WORDS)
    # Three words of the array, in order.
    keys = F.expr("flatten(transform(p, (x, i) -> flatten(transform(slice(p, i + 2, 99), (y, j) -> transform(slice(p, i + j + 3, 99), z -> xxhash64(x, y, z))))))")
    keys = F.when(F.col("size") < KEY_WORDS, F.array(F.xxhash64("p"))).otherwise(keys)
    return materialize(sets.join(ranked, "id").select(*ROW, "kind", first.alias("p")).select(*ROW, "kind", F.explode(keys).alias("key")), "keys")


def _side(rows: DataFrame, name: str, *more: str) -> DataFrame:
    return rows.select("key", "kind", *(F.col(c).alias(f"{name}_{c}") for c in (*ROW, *more)))


def _near(pairs: DataFrame) -> DataFrame:
    """The pairs of ``_side`` columns whose sets have ``SIMILARITY``, each once; the sketches spare most counts and no pair."""
    most = F.lit((1 - SIMILARITY) / (1 + SIMILARITY)) * (F.col("a_size") + F.col("b_size")) + 1e-9
    for c in SKETCHES:
        pairs = pairs.filter(F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) <= most)
    a, b = F.split("a_opening", " "), F.split("b_opening", " ")
    return (
        pairs.filter(F.size(F.array_intersect(a, b)) >= SIMILARITY * F.size(F.array_union(a, b)))
        .select("a_id", "b_id", F.col("a_opening").alias("a"), F.col("b_opening").alias("b"), "kind")
        .distinct()
    )


def opening_links(openings: DataFrame) -> DataFrame:
    """Verified links ``(a, b, kind)`` between distinct openings: columns opening, kind.

    Two openings are joined by the links, be it over others, exactly if pairs of ``SIMILARITY`` or more join
    them. Those with a key in common are candidates. If these are few, each is verified, and every pair is a link.
    Else members of a bucket are first compared with ``CENTRES`` of it, drawn by hash; pairs that links join by then need no other, and all
    pairs in a bucket that they don't join are verified, in blocks: members outside of its largest cluster with all.
    """
    keyed = _keyed(openings)
    buckets = materialize(keyed.groupBy("key", "kind").agg(F.count("*").alias("m")).filter("m > 1"), "buckets")
    rows, pairs = buckets.select(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum(F.expr("m * (m - 1D) / 2")), F.lit(0.0))).first()
    keyed = materialize(spread_join(keyed, buckets.drop("m"), ["key", "kind"], "left_semi"), "shared-keys")
    if pairs <= PAIRS_A_ROW * rows:
        return _near(pair_join(_side(keyed, "a"), _side(keyed, "b"), ["key", "kind"], "a_id", "b_id").filter("a_id < b_id")).select("a", "b", "kind")
    # The key in the hash: members that share a place in one bucket have places of their own in another.
    place = F.pmod(F.xxhash64("key", "id"), F.lit(CENTRES))
    centres = keyed.groupBy("key", "kind", place.alias("place")).agg(F.min(F.struct(*ROW)).alias("head"))
    centres = centres.groupBy("key", "kind").agg(F.collect_list("head").alias("heads"))  # CENTRES at most
    met = spread_join(_side(keyed, "b"), centres, ["key", "kind"]).withColumn("head", F.explode("heads"))
    met = met.select("*", *(F.col(f"head.{c}").alias(f"a_{c}") for c in ROW)).filter("a_id <> b_id")
    near = materialize(_near(met), "near")
    roots = components(near.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))).withColumnRenamed("node", "id")
    placed = materialize(spread_join(keyed, roots, ["id"], "left").withColumn("root", F.coalesce("root", "id")), "placed")
    main = placed.groupBy("key", "kind", "root").agg(F.count("*").alias("n")).groupBy("key", "kind").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("roots"))
    rest = materialize(spread_join(placed, main.filter("roots > 1").drop("roots"), ["key", "kind"]), "apart")
    others = pair_join(_side(rest.filter("root <> main"), "a", "root", "main"), _side(rest, "b", "root"), ["key", "kind"], "a_id", "b_id")
    others = others.filter("a_root <> b_root and (b_root = a_main or a_id < b_id)")
    return near.unionByName(_near(others)).select("a", "b", "kind").distinct()


def refusal_templates(found: DataFrame) -> DataFrame:
    """The openings that belong to a refusal template: opening, kind.

    ``found`` has opening, kind, prompt (a hash) and cue, a row per occurrence: 2 if the text says in so many words that it
    declines, 1 if it speaks in the first person or negates, else 0. Openings linked with each other, over any number of
    others, are one cluster; brief ones aren't linked. Prompts are counted once over a cluster, cues over all its texts.
    """
    heads = materialize(
        found.groupBy("opening", "kind").agg(F.hll_sketch_agg("prompt", 10).alias("prompts"), F.count("*").alias("n"), F.count_if(F.col("cue") > 0).alias("cues"), F.count_if(F.col("cue") > 1).alias("explicit")),
        "heads",
    )
    name = lambda c: F.concat_ws("|", F.col("kind").cast("string"), F.col(c))
    links = opening_links(heads.filter(F.col("kind") < AND_BRIEF)).select(name("a").alias("a"), name("b").alias("b"))
    roots = components(links)
    member = spread_join(heads.withColumn("node", name("opening")), roots, ["node"], "left").withColumn("root", F.coalesce("root", "node"))
    member = materialize(member, "members")
    clusters = member.groupBy("root").agg(
        F.hll_sketch_estimate(F.hll_union_agg("prompts")).alias("prompts"), F.first("kind").alias("kind"), *(F.sum(c).alias(c) for c in ("n", "cues", "explicit"))
    )
    recurs = F.col("prompts") >= MIN_PROMPTS
    brief = F.col("kind") >= AND_BRIEF
    good = clusters.filter((recurs & ~brief & (2 * F.col("cues") >= F.col("n"))) | ((recurs | ~brief) & (2 * F.col("explicit") >= F.col("n"))))
    return spread_join(member, good.select("root"), ["root"], "left_semi").select("opening", "kind")


def defect_of(i: str | None, s: str | None, p: str | None, c: str | None) -> str | None:
    """The defect of an answer by itself, refusals aside: prompt, selected phrase, edited phrase, edited caption."""
    ti, tc = _tokens(i or ""), _tokens(c or "")
    return _defect(i, s, p, c, ti, tc, set(ti))


def _defect(i, s, p, c, ti: list[str], tc: list[str], known: set[str]) -> str | None:
    shared = sum(t in known for t in tc)
    ci, cc = "".join(ti), "".join(tc)
    if not cc or cc in STAND_INS or is_empty(p):
        return "empty"
    if not ti:
        return None
    if 2 * shared <= len(tc) and other_language(i, c):
        return "other_language"
    if (tc[-1] != ti[-1] or tc[-1] in OPEN_ENDED or len(tc) < 2) and truncated(i, s, p, c):
        return "truncated"
    if (cc.endswith(ci) or ci.endswith(cc) or ":" in i) and copied(i, c):
        return "copy"
    return None


def _foreign(head: list[str], known: set[str]) -> bool:
    """Whether an opening shares few words with its prompt; function words tell nothing if it has enough others."""
    own = [t for t in head if t not in _LANG_OF]
    own = own if len(own) >= 3 else head
    return sum(t in known for t in own) <= SHARED * len(own)


def _openings(seq: list[str], known: set[str], least: int) -> Iterator[tuple[str, bool]]:
    """The beginnings of an answer that share few words with its prompt, each also with slots in place of the prompt's words, and whether it is a brief one."""
    if len(seq) > BRIEF and _foreign(seq[:BRIEF], known):
        yield " ".join(seq[:BRIEF]), True
    for n, shorter in zip(OPENINGS, (0, *OPENINGS)):
        head = seq[:n]
        if len(head) <= shorter or len(head) < least:
            return
        if _foreign(head, known):
            yield (plain := " ".join(head)), False
            if (slots := " ".join(SLOT if t in known and t not in _LANG_OF else t for t in head)) != plain:
                yield slots, False


def _cue(text: str, prompt: str | None, phrase: bool) -> int:
    return 2 if declines(text, prompt) else int(weak_cue(text, phrase))


def _scan(key: str):
    """One pass over the answers: defects by themselves, and openings that share few words with their prompt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, defect, opening, kind, prompt, cue = [], [], [], [], [], []
            for n, (i, s, p, c) in enumerate(zip(*(b.column(k).to_pylist() for k in range(1, 5)))):
                ti, tc = _tokens(i or ""), _tokens(c or "")
                known = set(ti)
                found = [(own, None, None, None)] if (own := _defect(i, s, p, c, ti, tc, known)) else []
                for seq, raw, of in ((tc, c, CAPTION), (_tokens(p or ""), p, PHRASE)):
                    heads = set(_openings(seq, known, 2 + of))
                    # What stands before a colon or the like may be a label or belong to the text: both are tried.
                    if raw and (":" in raw or "=" in raw or "-" in raw) and (label := _LABEL.match(raw)):
                        heads.update(_openings(seq[len(_tokens(label[0])) :], known, 2 + of))
                    if heads:
                        said = _cue(raw, i, of == PHRASE)
                        found.extend((None, opened, of + AND_BRIEF * brief, said) for opened, brief in heads)
                if not found:
                    continue
                start = int.from_bytes(hashlib.blake2b(" ".join(ti).encode(), digest_size=8).digest(), "big", signed=True)
                for f in found:
                    row.append(n)
                    prompt.append(start)
                    for column, v in zip((defect, opening, kind, cue), f):
                        column.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(defect, pa.string()), pa.array(opening, pa.string()), pa.array(kind, pa.int32()), pa.array(prompt, pa.int64()), pa.array(cue, pa.int32())],
                [key, "defect", "opening", "kind", "prompt", "cue"],
            )

    return run


def response_defects(rows: DataFrame, key: str, prompt: str, selected: str, phrase: str, caption: str) -> DataFrame:
    """``(key, defect)`` of the defective answers, once for each key.

    Of several defects the first of refusal, empty, other_language, truncated, copy counts; of rows
    with the same key (an answer delivered twice) likewise. A null prompt leaves only refusal and
    empty to be found; nulls in the other columns are defects as stated. A null key is kept as one.
    """
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, defect string, opening string, kind int, prompt bigint, cue int"
    found = materialize(dealt_out(rows.select(key, prompt, selected, phrase, caption)).mapInArrow(_scan(key), schema), "answers")
    own = found.filter("defect is not null").select(key, "defect")
    openings = found.filter("opening is not null")
    templates = refusal_templates(openings.select("opening", "kind", "prompt", "cue"))
    by_template = spread_join(openings.select(key, "opening", "kind"), templates, ["opening", "kind"], "left_semi").select(key, F.lit("refusal").alias("defect"))
    order = F.array_position(F.array(*map(F.lit, ("refusal", "empty", "other_language", "truncated", "copy"))), F.col("defect"))
    return own.unionByName(by_template).groupBy(key).agg(F.min_by("defect", order).alias("defect"))
