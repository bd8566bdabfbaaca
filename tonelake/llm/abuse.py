"""Scores for abusive, hateful or sexually explicit language.

A trie holds the lexicon (`llm/lexicon.py`). Each token of a text is read as a Levenshtein automaton intersected with
it, so masked (`f*ck`), stretched, number-for-letter, look-alike and misspelt forms reach the same words: look-alikes,
masks and stretches cost nothing, whole edits (one from 4 letters of the word on, two from 9) lower the hit's weight.
Tokens that are ordinary words of a public vocabulary are no misspellings. The words found carry tags; a sentence is
then scored by what the window around a hit says:

* threat: violence against a person or a person's body, wishes of death, unless a thing (a track, the bass) does it;
* insult: an insult that addresses or predicates a person, unless of oneself or of a thing;
* sexual: summed evidence of explicit words, sexual verbs with a person as object, and intimate parts with an owner;
* hate: a slur, or a group of people with a degrading or excluding predicate, unless denied.

Quotations in a sentence that reports, forbids or studies them, and words named as words, score 0. A text's score is
that of its worst window; from FLAG on it counts as abusive.

Defined results: null, empty and blank texts score 0; repeated rows score each; a text is read whole, in linear time;
scripts the lexicon lacks score 0; extra columns are ignored. Scoring needs no shuffle; rates per source are one
map-side aggregate.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.llm.folding import decode_marks, fold_word
from tonelake.llm.lexicon import BIT, CONTENT, JAPANESE, MASK, ONE_EDIT, TWO_EDITS, Lexicon, ordinary_words, squeeze, tagged_words
from tonelake.sources.tables import text_rows

FLAG = 1.0
#: Raw tokens whose reading is kept per worker; results do not depend on it.
KEPT = 1 << 17
#: Weight of a hit by its whole edits.
BY_EDITS = (1.0, 0.9, 0.85)
#: Public vocabularies whose whole words are ordinary words.
VOCABULARIES = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")

# fixed expressions as `weight | elements`: a tag is in capitals, `a/b` are alternatives, `_` lets up to two words pass, `__` up to six
IDIOMS = {
    "threat": """
1.2 | kill/hang/shoot/drown yourself/yourselves/urself
1.2 | kys
1.2 | drop dead
1.2 | go die/choke
1.2 | end your life
1.2 | hope you die/suffer/choke/rot/burn/bleed/crash
1.2 | hope he/she/they die/dies/rot/rots
1.2 | nobody/noone will/would miss you
1.2 | better off without you
1.2 | burn/rot in hell
1.2 | die in a fire/hole
1.2 | run/runs you over
1.2 | know/knows/find/found out where you live
1.2 | know/knows where you live
1.2 | watch your back
1.2 | geh sterben
1.2 | bringe/bring/mach/mache dich um/fertig/kalt
1.2 | muerete/crepa/krepier/verrecke/creve/stirb
1.2 | πεθανε/ψοφα""",
    "insult": """
1.2 | piece/pieces of shit/crap/filth/garbage/trash/dirt
1.2 | pathetic/sorry/poor excuse for
1.2 | waste of space/oxygen/skin/air
1.2 | stuck dreck/scheisse/mull
1.2 | pezzo/pezzi di merda
1.2 | pedazo/pedaco de mierda/merda/basura/lixo
1.2 | hijo/hija/hijos/filho/filha de/da puta
1.2 | figlio/figlia di puttana
1.2 | fils de pute
1.2 | son/sons of a/- bitch/bitches
1.2 | ta/vos gueule
1.2 | fuck/screw you
1.2 | fuck/piss/sod off
1.2 | go fuck yourself
1.2 | fick/verpiss dich
1.2 | vaffanculo
1.2 | va te faire
1.2 | vete/vayanse a la mierda
1.2 | vai se/te foder
1.2 | α γαμησου
1.2 | αι γαμησου
1.2 | INSULT de mierda/merda/merde
1.2 | callate/zitto/zitta INSULT/WEAK
1.2 | shut up INSULT/WEAK
1.2 | halt die fresse/klappe/schnauze
1.2 | nobody/noone loves/likes/wants you
1.2 | nadie te quiere
1.2 | ninguem gosta de voce
1.2 | monde te deteste/hait
1.2 | niemand mag dich
1.2 | nessuno ti vuole
1.2 | spit on you
1.2 | you make/makes me/us sick""",
    "sexual": """
1.2 | suck/sucks/sucking me/you/him/her/it off
1.2 | suck my/his/your
1.2 | jerk/jerked/jerking/wank/wanked/wanking off
1.2 | feel/felt/want you/him/her inside
1.2 | hard/big/wet/his/my/your cock/dick
1.2 | take/took/taking/takes her/him/me/you from behind
1.2 | sex/nude pics/videos/chat/photos
1.2 | hot sex
1.2 | have/had/having sex with you/her/him/me
1.2 | come/cum/came all over your/her/his/my
1.2 | spread your/her/his/my legs
1.2 | te/la/le/me baiser
1.2 | quero/vou te comer
1.2 | comerte entera/toda
0.8 | between your/her/his/my legs/thighs
0.6 | until/till he/she/i/they came/climaxed""",
    "hate": """
1.2 | go back to your country
1.2 | GROUPS __ make/makes me/us sick
1.2 | GROUPS __ no right/rights/place/business
1.2 | GROUPS __ not/never be allowed
1.2 | no GROUPS should/must/may/can be allowed/trusted/let
1.2 | GROUPS __ not human/people
1.2 | GROUPS __ dont/doesnt/not deserve/belong
1.2 | GROUPS __ only good for
1.2 | GROUPS __ let them rot/die/drown/starve
1.2 | GROUPS __ send/sent/ship/deport them _ home/back
1.2 | rid of _ GROUPS
1.2 | hate/despise GROUPS
1.2 | hate/despise all/those/these/the GROUPS
1.2 | GROUPS __ capiscono niente/nulla
1.2 | GROUPS __ comprennent rien
1.2 | GROUPS __ entienden nada
1.2 | GROUPS __ entendem nada
1.2 | GROUPS __ verstehen nichts""",
}

# fixed values: words the windows ask for
_CAUSE = set("make makes making made".split())
_FILLERS = set("a an the so such just still really very totally total complete completely absolute absolutely nothing but biggest most another only also all both too even quite truly bunch of fucking bloody ein eine so un une une um uma tan tao cosi tellement".split())
_ENDS = set("and but or to because when if who that for with as at like und et y e".split())
_PARTICLES = set("out off away home back up ab weg".split())
_NEED_PARTICLE = set("kept locked thrown sent kicked shipped keep throw send kick lock ship".split())
_BLAME = set("reason fault blame problem cause because schuld faute culpa".split())
_PEOPLE_OBJECTS = set("you her him me them dich ihn sie te la le lo ti lei lui".split())
_OWNERS = set("your ur her his my their dein deine deinen ta tes sa tu tus su sus tuo tua sua".split())
_KINSHIP = set("their your that this these".split())
_COLLECTIVES = set("kind religion faith race culture".split())
_BREEDING = set("breed breeds produce produces raise raises".split())
_FIGURATIVE_AFTER = set("up to at in into loose some slack softly".split())
#: Sexual verbs that are mostly used otherwise weigh less.
_MILD = set("kiss taste strip bang screw ride suck touch pull squeeze slid".split())

_EDGE_LEFT, _EDGE_RIGHT = "\"'“”„‘’«([{<>-–—…,.;:?¡¿*_~`#", "\"'“”„‘’»)]}<>-–—…,.;:?!¡¿_~`"
_SENTENCE = re.compile(r"(?<=[.!?…。！？])[\"'”’»)]*\s+|\n+")
_JAPANESE = re.compile("[぀-ヿ一-鿿]")
_SPEAKER = re.compile(r"^\s*(?:Re: |Fwd: )?[^\W\d_]{2,20}:\s+")
_APOSTROPHES = re.compile("['’‘ʼ`´]")
_INNER = re.compile(r"[._\-*·•/\\|,]+")
_SPLIT = re.compile(r"[^\w*]+")
_COMPOUND = re.compile(r"[^\W_]+(?:[-_/.][^\W_]+)+")
_OPENERS = {'"': '"', "“": "”", "”": "”", "„": "“”", "«": "»", "»": "«", "‘": "’", "「": "」", "『": "』"}
_OPENER = re.compile("[" + "".join(_OPENERS) + "]")
_JA_RULES = tuple((re.compile(p), kind, w) for p, kind, w in JAPANESE)
_ANCHOR = sum(BIT[t] for t in "VIOLENT ROUGH FOREIGN WEAPON SUFFER HARMED ASSAULT INSULT WEAK SCORN SLUR EXPLICIT INTIMATE GARMENT SEXVERB TOUCH".split())
_SEXUAL = sum(BIT[t] for t in "EXPLICIT INTIMATE GARMENT SEXVERB TOUCH".split())
_GROUPISH = sum(BIT[t] for t in "GROUP MIXED KIND FOLK".split())
# marks of readings beside their tags: collective nouns, and words that begin an idiom, sexual ones apart
_KIND_WORD, _BEGINS, _BEGINS_SEXUAL = (1 << (len(BIT) + k) for k in range(3))
_SUBJECT = BIT["I"] | BIT["YOU"] | BIT["PERSON"]


class Reading(NamedTuple):
    """What a token may stand for: words, their tags, and how sure it is."""

    words: frozenset[str]
    tags: int
    quality: float


def _elements(rule: str) -> list[tuple[int, frozenset[str], int]]:
    """(gap, words, tag bits) of each element."""
    out, gap = [], 0
    for part in rule.split():
        if set(part) == {"_"}:
            gap = 2 if len(part) == 1 else 6
        else:
            options = frozenset(part.split("/"))
            out.append((gap, options, sum(BIT[o] for o in options if o in BIT)))
            gap = 0
    return out


def quotations(line: str) -> list[tuple[int, int]]:
    """Spans of quotations of any length, in order; an open one is none. Each closing mark is sought once, so time is linear."""
    out: list[tuple[int, int]] = []
    at, none = 0, set()
    while m := _OPENER.search(line, at):
        opener, begin = m[0], m.start()
        at = begin + 1
        if opener in none or (opener == "‘" and begin and line[begin - 1].isalnum()):
            continue
        ends = [e for e in (line.find(c, begin + 1) for c in _OPENERS[opener]) if e >= 0]
        if opener == "‘":
            end = begin
            while (end := line.find("’", end + 1)) >= 0 and end + 1 < len(line) and line[end + 1].isalnum():
                pass
            ends = [end] if end >= 0 else []
        if not ends:
            none.add(opener)
        elif min(ends) > begin + 2:
            out.append((begin, min(ends) + 1))
            at = min(ends) + 1
    return out


class Scorer:
    def __init__(self, ordinary: set[str]):
        self.tags = tagged_words()
        self.idioms = [(kind, float(weight), _elements(rule)) for kind, text in IDIOMS.items() for weight, _, rule in (line.partition(" | ") for line in text.strip().splitlines())]
        for _, _, elements in self.idioms:
            for _, options, _ in elements:
                for w in options:
                    if not w.isupper():
                        self.tags.setdefault(fold_word(w), 0)
        content = sum(BIT[t] for t in CONTENT)
        self.fuzzy = {w for w, t in self.tags.items() if t & content}
        self.lexicon = Lexicon(self.tags, self.fuzzy)
        #: words that squeezing makes too short are matched as they stand, or by their stretched form
        self.firm = {w for w in self.tags if len(squeeze(w)) < 4}
        self.ordinary = ordinary
        self.kept: dict[str, tuple[Reading, ...]] = {}
        self.starts: dict[str, list] = {}
        for idiom in self.idioms:
            for w in idiom[2][0][1]:
                self.starts.setdefault(w if w.isupper() else fold_word(w), []).append(idiom)
        self.sexual_starts = {w for _, _, elements in (i for i in self.idioms if i[0] == "sexual") for w in elements[0][1]}
        self.first_tags = [(BIT[w], self.starts[w]) for w in self.starts if w.isupper() and w in BIT]
        self.begin_tags = sum(bit for bit, _ in self.first_tags) | _BEGINS

    # reading of tokens

    def is_ordinary(self, w: str) -> bool:
        """Whether the token is an ordinary word or an inflection of one."""
        known = self.ordinary
        if w in known:
            return True
        for end in ("s", "es", "ed", "d", "ing", "er", "ers", "ly", "en", "e", "n", "a", "o", "st"):
            if w.endswith(end) and len(w) - len(end) >= 4 and w[: len(w) - len(end)] in known and w[: len(w) - len(end)] not in self.fuzzy:
                return True
        return False

    def words_of(self, token: str) -> dict[str, int]:
        """The lexicon's words that a folded token stands for, with their edits."""
        if token in self.tags:
            return {token: 0}
        letters = sum(ch.isalpha() for ch in token)
        if not letters or len(token) > 40 or (letters < len(token) and letters * 3 < len(token) - token.count(MASK) - 2):
            return {}
        if token.count(MASK) * 2 > len(token):
            return {}
        found = {w: 0 for w in self.lexicon.near(token, 0)}
        if found:  # stretched or encoded: only words spelt with the same doubled letters or fewer
            found = {w: 0 for w in found if len(w) <= len(token) and (w not in self.firm or (len(w) >= 3 and (len(token) > len(w) or letters < len(token))))}
        if found or not (token.isalpha() or letters >= len(token) - 1) or MASK in token or self.is_ordinary(token):
            return found
        short = squeeze(token)
        if len(short) < ONE_EDIT - 1:
            return {}
        near = self.lexicon.near(token, 2 if len(short) >= TWO_EDITS - 1 else 1)
        return {w: e for w, e in near.items() if e <= 1 or len(squeeze(w)) >= TWO_EDITS}

    def _marks(self, words: frozenset[str]) -> int:
        out = _KIND_WORD if words & _COLLECTIVES else 0
        if any(w in self.starts for w in words):
            out |= _BEGINS
        return out | (_BEGINS_SEXUAL if words & self.sexual_starts else 0)

    def read(self, word: str) -> Reading:
        found = self.words_of(word)
        if not found:
            words = frozenset((word,))
            return Reading(words, self._marks(words), 1.0)
        tags = 0
        for w in found:
            tags |= self.tags[w]
        edits = min(found.values())
        if edits:  # a misspelling stands for its lexicon words only by what they may mean, not for function words
            tags &= ~(BIT["YOU"] | BIT["I"] | BIT["DET"])
        words = frozenset((word, *found))
        return Reading(words, tags | self._marks(words), BY_EDITS[edits])

    def raw(self, raw: str) -> tuple[Reading, ...]:
        """The readings of a blank-separated token."""
        got = self.kept.get(raw)
        if got is None:
            got = tuple(self.read(w) for w in self._parts(raw))
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[raw] = got
        return got

    def _parts(self, raw: str) -> list[str]:
        t = raw.lstrip(_EDGE_LEFT).rstrip(_EDGE_RIGHT)
        if not t:
            return []
        w = fold_word(t)
        if w.isalnum() and (w.isalpha() or w.isdigit()):
            return [w]
        bare = _APOSTROPHES.sub("", w)
        if bare.isalpha():
            return [bare]
        parts = _INNER.split(w)
        if len(parts) > 2 and all(len(p) <= 1 for p in parts):
            return ["".join(parts)]
        if _COMPOUND.fullmatch(w) and all(p.isalpha() for p in parts):
            return parts
        if self.words_of(w):
            return [w]
        return [p for p in _SPLIT.split(w) if p]

    def tokens(self, sentence: str) -> list[Reading]:
        out: list[Reading] = []
        singles = 0
        kept = self.kept
        for raw in sentence.split():
            out += kept.get(raw) or self.raw(raw)
            if len(raw) == 1:
                singles += 1
        return self._joined(out) if singles >= 3 else out

    def _joined(self, tokens: list[Reading]) -> list[Reading]:
        """Runs of single characters that spell a word of the lexicon, as that word."""
        letter = [next((w for w in r.words if len(w) == 1), "") for r in tokens]
        out, i, n = [], 0, len(tokens)
        while i < n:
            k = i
            while k < n and letter[k]:
                k += 1
            while i < k:
                b = next((b for b in range(min(k, i + 20), i + 2, -1) if self.words_of("".join(letter[i:b]))), None)
                if b:
                    out.append(self.read("".join(letter[i:b])))
                    i = b
                else:
                    out.append(tokens[i])
                    i += 1
            if k < n and i == k:
                out.append(tokens[k])
                i = k + 1
        return out

    # scoring of texts

    def score(self, text: str | None) -> tuple[float, str | None]:
        """The score of a text and the kind of its worst window."""
        best: tuple[float, str | None] = (0.0, None)
        if not text or not text.strip():
            return best
        text = decode_marks(text)
        if not text.isascii():
            text = unicodedata.normalize("NFKC", text)
        for line in text.split("\n"):
            line = _SPEAKER.sub("", line)
            quotes = quotations(line) if _OPENER.search(line) else []
            starts = [a for a, _ in quotes]
            begin, q = 0, 0
            ends = []
            for m in _SENTENCE.finditer(line):
                k = bisect_left(starts, m.start()) - 1
                if k < 0 or m.start() >= quotes[k][1]:
                    ends.append(m.span())
            for a, b in [*ends, (len(line), len(line))]:
                if a > begin:
                    inside = []
                    while q < len(quotes) and quotes[q][0] < a:
                        if quotes[q][0] >= begin:
                            inside.append((quotes[q][0] - begin, quotes[q][1] - begin))
                        q += 1
                    got = self._sentence(line[begin:a], inside)
                    if got[0] > best[0]:
                        best = got
                begin = b
        return best

    def _sentence(self, sentence: str, quotes: list[tuple[int, int]]) -> tuple[float, str | None]:
        if not quotes:
            return self._both(sentence)
        outside = "".join(_without(sentence, quotes))
        about = any(r.tags & BIT["REPORT"] for r in self.tokens(outside)) or "と言" in outside or "と書" in outside
        best = self._both(outside)
        if not about:
            for part in [*(sentence[a + 1 : b - 1] for a, b in quotes), sentence]:
                best = max(best, self._both(part), key=lambda s: s[0])
        return best

    def _both(self, sentence: str) -> tuple[float, str | None]:
        best = self._window(self.tokens(sentence))
        if not sentence.isascii() and _JAPANESE.search(sentence):
            for pattern, kind, weight in _JA_RULES:
                if weight > best[0] and pattern.search(sentence):
                    best = (weight, kind)
        return best

    def _window(self, read: list[Reading]) -> tuple[float, str | None]:
        best: tuple[float, str | None] = (0.0, None)
        tags = [r.tags for r in read]
        seen = 0
        for t in tags:
            seen |= t
        anchored = seen & _ANCHOR
        groups = self._groups(read) if seen & (_GROUPISH | _KIND_WORD) else frozenset()
        if not (anchored or groups or seen & self.begin_tags):
            return best
        found = []
        if anchored:
            found = [(max(self._threat(read, tags), self._assault(read, tags)), "threat"), (self._insult(read, tags), "insult")]
        if groups:
            found.append((self._hate(read, tags, groups), "hate"))
        if seen & (_SEXUAL | _BEGINS_SEXUAL):
            found.append((self._sexual(read, tags), "sexual"))
        best = max([*found, best], key=lambda s: s[0])
        starts = self.starts
        for i, t in enumerate(tags):
            if not t & self.begin_tags and i not in groups:
                continue
            r = read[i]
            lists = [starts[w] for w in r.words if w in starts]
            lists += [idioms for bit, idioms in self.first_tags if t & bit]
            if i in groups:
                lists.append(starts["GROUPS"])
            for idioms in lists:
                for kind, weight, elements in idioms:
                    if weight > best[0] and kind != "sexual" and self._follows(read, groups, i, elements):
                        best = max(best, (weight * self._told(read, i), kind), key=lambda s: s[0])
        return best

    def _follows(self, read: list[Reading], groups: frozenset[int], i: int, elements: list[tuple[int, frozenset[str], int]]) -> bool:
        """Whether the elements of an idiom appear in order from token i on, within their gaps."""
        ends = {i}
        for gap, options, bits in elements[1:]:
            ends = {k for e in ends for k in range(e + 1, min(len(read), e + 2 + gap)) if read[k].words & options or read[k].tags & bits or ("GROUPS" in options and k in groups)}
            if not ends:
                return False
        return True

    # windows: each gives the weight of its worst hit

    @staticmethod
    def _told(read: list[Reading], i: int) -> float:
        """0 where the hit is named as a word, given as an example, or what somebody was called; else 1."""
        near = read[max(0, i - 6) : i]
        for k in range(len(near) - 1):
            if "such" in near[k].words and "as" in near[k + 1].words:
                return 0.0
        return 0.0 if any(r.tags & BIT["NAMING"] and not r.words & {"such"} for r in near[-4:]) else 1.0

    @staticmethod
    def _by_thing(tags: list[int], i: int) -> bool:
        """Whether the subject of the verb at i, the nearest noun or pronoun before, is a thing."""
        for k in range(i - 1, max(-1, i - 9), -1):
            if tags[k] & _SUBJECT:
                return False
            if tags[k] & BIT["THING"]:
                return True
        return False

    def _threat(self, read: list[Reading], tags: list[int]) -> float:
        best, n = 0.0, len(read)
        verb = BIT["VIOLENT"] | BIT["ROUGH"]
        for i, t in enumerate(tags):
            if t & BIT["FOREIGN"]:
                near = tags[max(0, i - 5) : i] + tags[i + 1 : i + 6]
                you = any(x & BIT["YOU"] for x in near)
                body = any(tags[k] & BIT["BODY"] and (tags[k - 1] & (BIT["YOUR"] | BIT["DET"])) for k in range(i + 1, min(n, i + 6)))
                if you and (body or any(x & (BIT["MODAL"] | BIT["I"] | BIT["DEATH"]) for x in near) or (read[i].quality == 1.0 and any(w.endswith(("o", "ω")) for w in read[i].words))):
                    best = max(best, 1.2 * read[i].quality * self._told(read, i))
            elif t & verb and not (i and tags[i - 1] & (BIT["DET"] | BIT["POSS"]) and not tags[i - 1] & BIT["I"]) and not self._by_thing(tags, i):
                best = max(best, self._violence(read, tags, i) * read[i].quality * self._told(read, i))
            elif t & BIT["WEAPON"]:
                for k in range(i + 1, min(n, i + 5)):
                    if tags[k] & BIT["BODY"] and tags[k - 1] & BIT["YOUR"] and read[k - 1].words & _OWNERS and not self._by_thing(tags, i):
                        best = max(best, 1.2 * self._told(read, i))
            if read[i].words & _CAUSE and i + 2 < n and tags[i + 1] & BIT["YOU"] and tags[i + 2] & BIT["SUFFER"] and not self._by_thing(tags, i):
                best = max(best, 1.2 * self._told(read, i))
            if "deserve" in read[i].words and any(x & BIT["YOU"] for x in tags[max(0, i - 3) : i]) and not any(x & BIT["NOT"] for x in tags[max(0, i - 2) : i]) and any(x & BIT["HARMED"] for x in tags[i + 1 : i + 5]):
                best = max(best, 1.2 * self._told(read, i))
        return best

    @staticmethod
    def _assault(read: list[Reading], tags: list[int]) -> float:
        n, best = len(read), 0.0
        for i, r in enumerate(read):
            if r.words & {"rape", "raped", "raping", "rapes"} and i + 1 < n and read[i + 1].words & _PEOPLE_OBJECTS and not any(x & (BIT["REPORT"] | BIT["NOT"]) for x in tags):
                best = max(best, 1.1)
        return best

    @staticmethod
    def _violence(read: list[Reading], tags: list[int], i: int) -> float:
        """Violence of an English verb at i against the person addressed or a body, by its object."""
        n, strong = len(read), bool(tags[i] & BIT["VIOLENT"])
        modal = any(x & (BIT["MODAL"] | BIT["WISH"]) for x in tags[max(0, i - 6) : i])
        for k in range(i + 1, min(n, i + 8)):
            if tags[k] & (BIT["BODY"] | BIT["HOME"]) and tags[k - 1] & BIT["YOUR"] and read[k - 1].words & (_OWNERS - {"my"} | {"those"}):
                mine = not read[k - 1].words & {"her", "his", "their"}
                return 1.2 if mine and (strong or modal or tags[k] & BIT["BODY"]) else 0.9
            if tags[k] & BIT["YOU"] and not tags[k] & BIT["MODAL"]:
                if k != i + 1 and not (k == i + 2 and read[i + 1].words & {"all", "the", "both"}):
                    continue
                after = read[k + 1] if k + 1 < n else None
                if strong and after and after.words & {"in"} and any(x & BIT["BODY"] for x in tags[k + 2 : k + 5]):
                    return 1.2
                if after and (after.words & _FIGURATIVE_AFTER or (after.tags & BIT["DET"] and not (k + 2 < n and tags[k + 2] & BIT["BODY"])) or (after.tags & (BIT["BODY"] | BIT["HOME"]))):
                    if after.tags & (BIT["BODY"] | BIT["HOME"]):
                        return 1.1
                    return 0.0
                if read[k].words & {"yourself", "yourselves", "urself"}:
                    return 1.2 if strong else 0.5
                return 1.2 if strong else 1.1 if modal else 0.8
        return 0.0

    def _insult(self, read: list[Reading], tags: list[int]) -> float:
        best = 0.0
        any_insult = BIT["INSULT"] | BIT["WEAK"]
        for i, t in enumerate(tags):
            if t & BIT["SLUR"]:
                # a short slur misspelt needs somebody it is said to
                sure = read[i].quality == 1.0 or max(map(len, read[i].words)) > 6 or any(x & BIT["YOU"] for x in tags[max(0, i - 6) : i + 4])
                best = max(best, (1.2 if sure else 0.8) * read[i].quality * self._told(read, i))
            if t & any_insult:
                best = max(best, self._directed(read, tags, i) * read[i].quality * self._told(read, i))
            elif t & BIT["SCORN"] and i:
                best = max(best, self._scorned(read, tags, i) * read[i].quality * self._told(read, i))
        if len(read) <= 4 and any(t & BIT["INSULT"] for t in tags) and all(t & (any_insult | BIT["SCORN"] | BIT["YOU"] | BIT["DET"]) for t in tags):
            best = max(best, 1.05 * min(r.quality for r in read if r.tags & BIT["INSULT"]) + 0.05)
        return best

    @staticmethod
    def _scorned(read: list[Reading], tags: list[int], i: int) -> float:
        """`you are (so) pathetic`: the person addressed is scorned as such."""
        k = i - 1
        while k >= 0 and i - k <= 5 and (read[k].words & _FILLERS or tags[k] & BIT["SCORN"]) and not tags[k] & BIT["COPULA"]:
            k -= 1
        if not (k >= 0 and tags[k] & BIT["COPULA"] and (read[k].words & {"youre"} or (k and tags[k - 1] & BIT["YOU"]))):
            return 0.0
        after = read[i + 1] if i + 1 < len(read) else None
        return 1.1 if after is None or after.words & _ENDS or after.tags & BIT["PERSON"] else 0.4

    @staticmethod
    def _directed(read: list[Reading], tags: list[int], i: int) -> float:
        """Weight of an insulting noun by whom it is said of."""
        weak = not tags[i] & BIT["INSULT"]
        scorned = any(x & BIT["SCORN"] for x in tags[max(0, i - 3) : i])
        base = 0.7 if not weak else 0.6 if scorned else 0.3
        begin = max(0, i - 8)
        copula = next((k for k in range(i - 1, begin - 1, -1) if tags[k] & BIT["COPULA"]), None)
        before = tags[begin:i]
        addressed = any(x & BIT["YOU"] for x in tags[max(0, i - 10) : i + 5])
        if copula is not None:
            contracted = read[copula].words & {"am", "im", "youre", "shes", "hes", "theyre"}
            subject = tags[copula - 1] if copula and not contracted else 0
            if read[copula].words & {"am", "im"} or (subject & BIT["I"] and not subject & BIT["YOU"]):
                if not any(x & BIT["YOU"] for x in before):
                    return 0.0
            elif contracted or subject & BIT["YOU"] or (subject & BIT["PERSON"] and any(x & BIT["YOU"] for x in tags[max(0, copula - 4) : copula])):
                near = all(read[k].words & _FILLERS or tags[k] & (BIT["SCORN"] | BIT["DET"]) for k in range(copula + 1, i))
                return max(base + 0.6, 1.05 if weak and near else 0.0)
            elif subject & BIT["THING"] and not any(x & (BIT["YOU"] | BIT["PERSON"]) and not x & BIT["THING"] for x in tags[max(0, copula - 4) : copula]):
                return base
        if addressed:
            return base + 0.6
        if any(r.words & {"whoever", "bunch"} or (r.words & {"what", "such", "che", "quel", "que", "was"} and tags[begin + k + 1] & BIT["DET"]) for k, r in enumerate(read[begin:i])) or (copula is not None and copula > 0):
            return base + 0.5
        return base

    def _sexual(self, read: list[Reading], tags: list[int]) -> float:
        n, total, erotic = len(read), 0.0, 0.0
        wish = any(t & (BIT["WISH"] | BIT["MODAL"]) for t in tags)
        for i, t in enumerate(tags):
            told = self._told(read, i) * read[i].quality if t & _ANCHOR else 1.0
            for w in read[i].words:
                for kind, weight, elements in self.starts.get(w, ()):
                    if kind == "sexual" and self._follows(read, frozenset(), i, elements):
                        total += weight * self._told(read, i)
            if t & BIT["EXPLICIT"]:
                # a short word misspelt needs support from its window
                total += (1.2 if read[i].quality == 1.0 or max(map(len, read[i].words)) > 6 else 0.8) * told
                continue
            noun = i and tags[i - 1] & (BIT["DET"] | BIT["POSS"]) and not tags[i - 1] & BIT["YOU"]
            if t & (BIT["SEXVERB"] | BIT["TOUCH"]) and not noun and i + 1 < n and read[i + 1].words & _PEOPLE_OBJECTS:
                owner = read[i + 1].words & _OWNERS and i + 2 < n and not tags[i + 2] & (BIT["MODAL"] | BIT["NOT"])
                into = i + 2 < n and read[i + 2].words & {"in", "into", "down", "along", "up"}
                if not owner and not into and not self._by_thing(tags, i):
                    mild = read[i].words & _MILD or not t & BIT["SEXVERB"]
                    total += (0.45 if mild else 0.8) * told + (0.35 if wish else 0.0)
            if t & (BIT["INTIMATE"] | BIT["GARMENT"]):
                owned = i and read[i - 1].words & _OWNERS
                beside = any(x.words & {"you", "her", "him", "dich", "te", "ti"} for x in read[max(0, i - 1) : i + 2])
                touched = any(x & (BIT["TOUCH"] | BIT["SEXVERB"]) for x in tags[max(0, i - 5) : i])
                if owned or (t & BIT["INTIMATE"] and beside):
                    total += ((0.6 if t & BIT["INTIMATE"] else 0.3) + (0.4 if touched else 0.3 if wish and beside else 0.0)) * told
            if t & BIT["EROTIC"]:
                erotic += 0.2
        return total + min(erotic, 0.4) if total > 0 else 0.0

    @staticmethod
    def _groups(read: list[Reading]) -> frozenset[int]:
        """Positions of words that name a group of people."""
        out = set()
        for i, r in enumerate(read):
            t = r.tags
            after = read[i + 1] if i + 1 < len(read) else None
            if t & BIT["KIND"] and after and after.tags & BIT["FOLK"]:
                out.add(i + 1)
            elif t & BIT["MIXED"]:
                if after and after.tags & BIT["FOLK"]:
                    out.add(i + 1)
                elif r.words & {"blacks", "asians", "christians"}:
                    out.add(i)
            elif t & BIT["GROUP"] and not (after and after.tags & BIT["THING"]):
                out.add(i)
            elif "people" in r.words and after and after.words & {"from"}:
                out.add(i)
            elif r.words & _COLLECTIVES and i and read[i - 1].words & _KINSHIP and not (after and after.words & {"of", "in"}):
                out.add(i)
        return frozenset(out)

    def _hate(self, read: list[Reading], tags: list[int], groups: frozenset[int]) -> float:
        best, n = 0.0, len(read)
        for g in groups:
            worst = 0.0
            for p in range(max(0, g - 6), min(n, g + 16)):
                t = tags[p]
                if p == g:
                    continue
                denied = any(x & BIT["NOT"] for x in tags[max(0, p - 3) : p]) and not (p and any("only" in r.words for r in read[max(0, p - 3) : p]))
                between = tags[g + 1 : p] if p > g else []
                said = any(x & BIT["COPULA"] for x in between) or any(read[k].words & _BREEDING for k in range(g + 1, p))
                if t & BIT["VILE"] and not denied and (said or p < g):
                    worst = max(worst, 1.2 * read[p].quality)
                if t & BIT["DEGRADE"] and p > g and not denied and (said or (p <= g + 3 and read[p].words & {"breed", "steal", "stink", "stinks"}) or any(read[k].words & {"too", "only", "spread", "carry"} for k in range(g + 1, p))):
                    worst = max(worst, 1.2 * read[p].quality)
                # `no one of them should be sent away` takes their part
                if t & BIT["EXCLUDE"] and p > g and not denied and not (g and tags[g - 1] & BIT["NOT"]):
                    firm = not read[p].words & _NEED_PARTICLE or any(read[k].words & _PARTICLES for k in range(p + 1, min(n, p + 4)))
                    if firm and (p == g + 1 or any(x & BIT["MODAL"] for x in between) or read[p].words & {"raus", "fuera", "echen", "fuori", "degagent", "degager", "dehors", "fora"}):
                        worst = max(worst, 1.2)
                if t & BIT["RUIN"] and p > g and not denied and (p <= g + 4 or any(read[k].words & _BLAME for k in range(g + 1, p))):
                    worst = max(worst, 1.2)
                if t & (BIT["VIOLENT"] | BIT["FOREIGN"]) and p < g and g - p <= 4 and not denied and not self._by_thing(tags, p):
                    worst = max(worst, 1.2 * read[p].quality)
            best = max(best, worst * self._told(read, g))
        return best


def _without(s: str, spans: list[tuple[int, int]]) -> Iterator[str]:
    at = 0
    for a, b in spans:
        yield s[at:a] + " "
        at = b
    yield s[at:]


_SCORERS: dict[int, Scorer] = {}


def shared_scorer(key: int, vocabularies: list[bytes]) -> Scorer:
    """One scorer per worker and vocabularies."""
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(ordinary_words(vocabularies))
    return _SCORERS[key]


def read_vocabularies(paths: tuple[str, ...] = VOCABULARIES) -> list[bytes]:
    """The vocabularies' bytes, refused beyond what a broadcast may hold."""
    out = []
    for path in paths:
        with open(path, "rb") as f:
            out.append(f.read())
    if sum(map(len, out)) > 64_000_000:
        raise ValueError("vocabularies of over 64 MB are not broadcast")
    return out


def scores(docs: DataFrame, doc_id: str, text: str, keep: list[str] | None = None, vocabularies: tuple[str, ...] = VOCABULARIES) -> DataFrame:
    """(doc_id, score, kind, *keep) of every row. The vocabularies (about 1 MB each) are read by the driver and broadcast."""
    keep = keep or []
    content = read_vocabularies(vocabularies)
    sent, key = docs.sparkSession.sparkContext.broadcast(content), hash(tuple(content))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), *(F.col(c).cast("string").alias(f"keep_{c}") for c in keep))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("kind", pa.string()), *((c, pa.string()) for c in keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared_scorer(key, sent.value)
        for batch in text_rows(batches):
            got = [scorer.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in got], pa.float64()), pa.array([k for _, k in got], pa.string()), *(batch.column(2 + i) for i in range(len(keep)))], schema=schema)

    return rows.mapInArrow(run, "doc_id bigint, score double, kind string" + "".join(f", `{c}` string" for c in keep))
