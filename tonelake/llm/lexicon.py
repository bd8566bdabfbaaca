"""The lexicon of abusive language, and the Levenshtein automata that read misspelled tokens against its trie.

The word lists are compiled by hand from general knowledge of the languages (English, German, French, Spanish, Italian,
Portuguese, Greek, Japanese); no third-party list is included. `word+s+ing` stands for the word and its forms with
these endings. Ordinary words, which are no misspellings, come from the whole words of public vocabularies.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from tonelake.llm.folding import fold_word
from tonelake.llm.tokens import read_ranks

TAGS = (
    "ASSAULT YOU YOUR I PERSON THING DET POSS MODAL WISH COPULA NOT VIOLENT ROUGH HARMED WEAPON BODY HOME SUFFER DEATH FOREIGN "
    "INSULT WEAK SCORN SLUR GROUP MIXED KIND FOLK VILE DEGRADE EXCLUDE RUIN EXPLICIT INTIMATE SEXVERB TOUCH GARMENT EROTIC THEM REPORT NAMING"
).split()
BIT = {t: 1 << i for i, t in enumerate(TAGS)}
#: Tags whose words may be misspelt by whole edits; the others are function words and common words, matched as they stand.
CONTENT = "VIOLENT FOREIGN INSULT WEAK SCORN SLUR VILE EXPLICIT INTIMATE SEXVERB".split()

LEXICON = {
    "YOU": "you u ya ur youre youve youll yourself yourselves urself du dich dir euch ihr tu te toi vous t ti tuo tua tue suo sei eres usted ustedes vosotros os voce voces seu sua es esse εισαι εσυ σε σου",
    "YOUR": "your ur yr those dein deine deinen deiner dir ta ton tes votre vos tu tus su sus tuo tua tuoi sua seu teu tua la le il a σου",
    "I": "i im ive ill id me my myself we us our well were ich mich mir wir je moi nous yo me nosotros io mi noi eu nos εγω",
    "PERSON": "he she hes shes they theyre who whoever everybody everyone somebody someone nobody anyone engineer+s participant+s listener+s reviewer+s host+s supervisor+s assistant+s producer+s singer+s drummer+s member+s user+s guy+s man men woman women people person+s kid+s author+s mother mum mom father brother sister er sie il elle el ella lui lei ele ela",
    "THING": "mix mixes song+s track+s sound+s chorus verse+s bridge intro outro it its that this these drop bass line+s groove version+s take+s record album beat+s kick snare drum+s guitar+s vocal+s piano riff+s melody hook+s reverb plugin+s room solo voice cable scene night day show feedback part+s ending tune noise lyrics harmony",
    "DET": "the a an some any another one every each no der die das den dem ein eine einen un une el los las una lo gli uno o os um uma",
    "POSS": "your ur my his her their our its dein deine ta ton sa son tu su tuo sua seu",
    "MODAL": "will ll shall would going gonna must should ought need needs have better let lets let's can could werde werd wird sollen sollten muss mussen voy vas va vais allons vado vamos vou vai debe deben deberian doit doivent devono devem θα πρεπει que",
    "WISH": "hope wish want wanna wants love like cant tonight let wait dying dm quiero quero will envie veux voglio me ich gonna going θελω",
    "COPULA": "is are was were am im re be been youre shes hes theyre s bist ist sind seid es est sont etes sommes sei e sono siete eres son sois sea e sao ειναι εισαι look looks sound sounds",
    "NOT": "not no never dont doesnt didnt arent isnt cannot nicht kein keine nie ne pas non sin nao nunca δεν μην without",
    "VIOLENT": "kill+s+ing murder+s+ing stab+s shoot+s slit strangle+s choke+s torture+s slaughter+s behead+s lynch burn+s smash+es+ing drown+s skin maim cripple shove+s gas exterminate execute gut",
    "ROUGH": "beat+s hit+s cut+s kick+s hurt+s punch+es slap+s break+s breaking whip+s hang+s crush+es rip+s bash throw+s push+es run+s knock+s bury destroy+s end",
    "FOREIGN": "umbringen umbring toten tote abstechen schlag schlage schlagen hau haue verprugeln erschiessen tuer frapper crever casser cogner egorger matar golpear apunalar partir romper reventar ammazzo ammazzare uccido uccidere spacco spaccare picchio bater arrebentar quebrar espancar esfaquear σκοτωσω σκοτωνω δειρω",
    "ASSAULT": "rape rapes raped raping",
    "HARMED": "beaten shot hanged killed raped stabbed burned burnt punished hurt whipped lynched murdered suffer die punched executed gassed",
    "WEAPON": "hammer axe knife gun bat rifle machete blade bomb bullet rope messer waffe couteau cuchillo pistola coltello faca μαχαιρι",
    "BODY": "face+s finger+s throat+s teeth skull neck head leg+s bone+s eye+s hand+s arm+s knee+s jaw nose rib+s guts spine fresse fratze zahne nase kopf gesicht figure gueule tete gorge cara cabeza cuello garganta faccia testa gola cabeca pescoco μουτρα κεφαλι chest",
    "HOME": "house home family kids children mother car wife husband haus familie maison famille casa familia famiglia",
    "SUFFER": "bleed beg suffer regret pay cry hurt scream sorry bluten leiden souffrir sufrir soffrire sofrer",
    "DEATH": "die dead suicide yourself urself dies rot sterben mourir morir morire morrer",
    "INSULT": "idiot+s idiota+s idiotin idiotes imbecile+s imbecil imbeciles imbecille imbecilli moron+s cretin+s cretino cretini scumbag+s asshole+s arsehole+s bastard+s bastardo+s bitch+es wanker+s twat+s tosser+s dickhead+s motherfucker+s fucker+s shithead+s loser+s halfwit+s retard+s slut+s whore+s cunt+s prick+s douchebag+s dumbass+es dipshit+s jackass imbeciles nitwit+s vollidiot+en arschloch arschlocher wichser hurensohn missgeburt schlampe drecksau vollpfosten trottel depp spasti connard+s connasse+s salope+s salaud+s encule+s abruti+s batard+s cabron+es gilipollas pendejo+s zorra+s estupido imbecil stronzo stronza stronzi coglione coglioni troia puttana otario+s babaca+s vagabunda+s arrombado cuzao malaka μαλακα μαλακασ μαλακεσ vlaka βλακα βλακασ βλακεσ ηλιθιε ηλιθιοσ ηλιθια πουτανα καριολη καριολησ ξεφτιλα",
    "WEAK": "clown+s fool+s pig+s rat+s cow+s dog+s snake+s swine worm+s animal+s monkey+s ape+s donkey coward+s freak+s creep+s trash scum garbage filth schwein schweine sau dreck abschaum mull cochon+s porc+s ordure dechet cerdo+s cerda perro basura escoria maiale+s vacca porco porca feccia lixo mierda merde merda merdas burro σκουπιδι γουρουνι",
    "SCORN": "stupid dumb ugly filthy worthless useless pathetic lying disgusting miserable braindead brainless dirty fucking rotten lazy fat deaf-eared clueless hopeless wertlos wertloser wertloses dumm dumme dummes blode hasslich sale inutile inutil stupide miserabile asqueroso asquerosa estupida estupido nojento nojenta burra ridiculous idiotic moronic repulsive revolting ηλιθιο αχρηστε αχρηστοσ",
    "SLUR": "nigger+s nigga+s faggot+s fag+s kike+s wetback+s raghead+s towelhead+s gook+s chinaman tranny trannies shemale+s paki+s kanake+n neger bougnoule+s negrata+s youpin sudaca+s maricon+es frocio froci ricchione viado+s sapatao jewboy zipperhead",
    "GROUP": "believer+s worshipper+s girls foreigner+s immigrant+s refugee+s migrant+s gays lesbians jew+s muslim+s arab+s mexican+s gypsies homosexuals auslander frauen juden fluchtlinge schwule turken muslime etrangers femmes arabes juifs immigres musulmans noirs mujeres inmigrantes extranjeros negros judios gitanos donne stranieri immigrati ebrei musulmani zingari mulheres imigrantes estrangeiros judeus pretos women γυναικεσ ξενοι μεταναστεσ εβραιοι",
    "MIXED": "woman blind deaf blacks asians christians",
    "KIND": "gay trans black white brown asian arab jewish muslim old poor disabled religious lesbian homeless foreign queer fat autistic immigrant",
    "FOLK": "people listener+s engineer+s participant+s women men folk folks musician+s girls boys person+s workers kids man woman",
    "THEM": "them they all their these those alle tous todos tutti ολουσ",
    "VILE": "vermin cockroach+es parasite+s subhuman+s thieves criminals savages animals rapists terrorists plague disease gesindel ungeziefer parasiten pack verbrecher parasitas parassiti plaga praga untermenschen vermine racaille ladri ladrones ladroes escoria feccia scum pigs rats apes monkeys trash filth παρασιτα κλεφτεσ",
    "DEGRADE": "stupid dumb lazy inferior stink stinks dirty filthy disgusting breed steal worthless useless burden diseased primitive violent weak sick retarded brainless disease diseases uncivilized dumm minderwertig inferieurs inferiores inferiori stupides estupidas ignorant untermenschlich κατωτεροι",
    "EXCLUDE": "wiped locked kept thrown deported banned gassed shot killed hanged sterilised sterilized removed eliminated exterminated raus raushalten fuera echen fuori degagent degager dehors fora expulsados abgeschoben silenced burned εξω",
    "RUIN": "ruin+s ruined destroy+s destroyed poison+s infest+s invade+s rotting spoil+s spoiled dying worse collapse wreck+s zerstoren ruinieren rot",
    "EXPLICIT": "horny pussy pussies tits titties nipple+s nudes blowjob+s dildo+s handjob+s cumshot+s boobs threesome gangbang ficken fickst durchficken muschi titten follarte follar follando polla scopare scoparti scopami buceta chupartela wichsen bumsen enculer γαμησω γαμησουμε βυζια",
    "INTIMATE": "tits breast+s ass butt panties nipple+s cock dick thighs crotch bra groin naked nackt nackten nue nu desnuda desnudo nuda pelada clit balls vagina penis clitoris erection orgasm+s",
    "GARMENT": "trousers pants skirt panties bra underwear shirt dress knickers boxers",
    "SEXVERB": "lick+s licking fuck+s fucking suck+s sucking ride mount bang strip undress taste spank seduce hump finger grope kiss shag screw",
    "TOUCH": "stroke+s stroked rub+s rubbed caress+es caressed fondle+s fondled grope+s groped undressed undress kissed squeeze squeezed slid fingered touch touched lick licked unzipped pull",
    "EROTIC": "moan+s moaned moaning scream screamed sex sexy wet naked came cum climax bed nackt nacht pics aroused hard desnuda nue nuda",
    "REPORT": "written wrote complained complaint reply replies removed deleted warned moderator moderators moderation rules accept accepted forbidden banned policy insult insults remarks comments called reported reports quoted quote quotes lyrics describe describes described messages message studies study paper article headline example examples slur slurs term terms word words chapter novel film documentary history historical survey research gelosch gemeldet signale denunciado segnalato denunciado",
    "NAMING": "called such word words term terms named reads word slur insult nannte genannt appele llamo chiamato chamou",
}

#: Terms of Japanese, which has no blanks: (pattern, kind, weight).
JAPANESE = (
    ("死ね|殺す(?:ぞ|よ|から)|殺してやる|ぶっ殺|くたばれ|刺してやる|殴ってやる", "threat", 1.2),
    ("(?:馬鹿|バカ|ばか|クソ|くそ|アホ|ゴミ|クズ|カス)(?:野郎|女|ども)|(?:お前|おまえ|てめえ|貴様|あんた|君)[はがもって、 ]{0,3}[^。！？\n]{0,8}?(?:馬鹿|バカ|ばか|クズ|ゴミ|カス|アホ|ブス|キモ)|消え失せろ|黙れ(?:ブス|バカ|クズ)", "insult", 1.2),
    ("(?:外国人|在日|黒人|女|移民|障害者|同性愛者)[はがども]{1,3}[^。！？\n]{0,10}?(?:寄生虫|ゴキブリ|劣等|出て行け|出ていけ|死ね|バカ|馬鹿|ゴミ)", "hate", 1.2),
    ("まんこ|ちんこ|ちんぽ|おっぱい(?:を|見せ|触|揉)|セックスし(?:たい|よう|て)|フェラ(?:し|チオ)|犯してやる|中出し", "sexual", 1.2),
)

# characters written for letters, and the letters each stands for
_STANDS = {"0": "o", "1": "il", "!": "il", "|": "il", "3": "e", "€": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "+": "t", "8": "b", "9": "g", "6": "gb", "(": "c", "v": "vu"}
_RUN = re.compile(r"(.)\1+")
MASK = "*"
#: Whole edits allowed from so many letters of the lexicon's word on.
ONE_EDIT, TWO_EDITS = 4, 9


def squeeze(w: str) -> str:
    """Repeated letters as one, so that stretched spellings meet."""
    return _RUN.sub(r"\1", w)


def expand(entries: str) -> list[str]:
    """`word+s+ing` as the word and its forms."""
    out = []
    for entry in entries.split():
        word, *ends = entry.split("+")
        forms = [word, *(word[:-1] + e if word.endswith("e") and e[0] in "ei" else word + e for e in ends)]
        out += [fold_word(f.replace("'", "").replace("-", "")) for f in forms]
    return out


def tagged_words() -> dict[str, int]:
    """Folded word -> tag bits."""
    out: dict[str, int] = {}
    for tag, entries in LEXICON.items():
        for w in expand(entries):
            out[w] = out.get(w, 0) | BIT[tag]
    return out


def ordinary_words(vocabularies: Iterable[bytes]) -> set[str]:
    """The folded whole words, of three letters or more, of byte-level vocabularies."""
    out = set()
    for content in vocabularies:
        for token in read_ranks(content):
            try:
                word = token.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if len(word) > 3 and word[0] == " " and word[1:].isalpha():
                out.add(fold_word(word[1:]))
    return out


def _insert(root: dict, spelling: str, word: str) -> None:
    for ch in spelling:
        root = root.setdefault(ch, {})
    root.setdefault("", set()).add(word)


class Lexicon:
    """Tries of the words, read from both ends, intersected with the Levenshtein automaton of a token.

    A position of the token accepts a set of letters (what it may stand for), so look-alike characters, masks and
    stretched letters cost nothing; whole edits (a letter changed, missing or added, neighbours swapped) cost one each.
    With few edits one half of the token is free of them, so the trie is entered by an exact half from either end.
    """

    def __init__(self, words: Iterable[str], content: Iterable[str]):
        self.exact_root: dict = {}
        self.whole: dict = {}
        self.ahead: dict = {}
        self.behind: dict = {}
        for w in words:
            _insert(self.whole, w, w)
            _insert(self.exact_root, squeeze(w), w)
        for w in content:
            s = squeeze(w)
            if len(s) >= ONE_EDIT:
                _insert(self.ahead, s, w)
                _insert(self.behind, s[::-1], w)

    def near(self, token: str, budget: int) -> dict[str, int]:
        """Words within `budget` edits of what the token may stand for, with their edits."""
        if MASK in token:
            return self._walk(self.whole, [None if ch == MASK else _STANDS.get(ch, ch) for ch in token], 0, 0)
        accept: list[str | None] = []
        for ch in token:
            a = _STANDS.get(ch, ch)
            if not accept or accept[-1] != a:
                accept.append(a)
        if not budget:
            return self._walk(self.exact_root, accept, 0, 0)
        half = len(accept) // 2
        found = self._walk(self.ahead, accept, half, budget)
        for w, e in self._walk(self.behind, accept[::-1], len(accept) - half, budget).items():
            found[w] = min(e, found.get(w, e))
        if budget > 1:  # one edit in either half
            for w, e in self._walk(self.ahead, accept, half, budget, 1).items():
                found[w] = min(e, found.get(w, e))
        return found

    @staticmethod
    def _walk(root: dict, accept: list[str | None], firm: int, budget: int, early: int = 0) -> dict[str, int]:
        """Words along trie paths that the automaton accepts, with at most `early` edits in the first `firm` positions."""
        n = len(accept)
        found: dict[str, int] = {}
        seen: dict[tuple[int, int], int] = {}
        stack = [(root, 0, 0)]
        while stack:
            node, i, e = stack.pop()
            if seen.get((id(node), i), budget + 1) <= e:
                continue
            seen[(id(node), i)] = e
            if i == n:
                for w in node.get("", ()):
                    if e < found.get(w, budget + 1):
                        found[w] = e
            if i < n:
                a = accept[i]
                if a is None:
                    stack += [(child, i + 1, e) for ch, child in node.items() if ch]
                else:
                    for ch in a:
                        child = node.get(ch)
                        if child is not None:
                            stack.append((child, i + 1, e))
            if e >= (budget if i >= firm else early):
                continue
            if i < n:
                stack.append((node, i + 1, e + 1))  # a letter too many
            for ch, child in node.items():
                if ch:
                    stack.append((child, i, e + 1))  # a letter missing
                    if i < n:
                        stack.append((child, i + 1, e + 1))  # another letter
                        if i + 1 < n and accept[i + 1] and ch in accept[i + 1]:
                            for c2 in accept[i] or "":
                                if c2 in child:
                                    stack.append((child[c2], i + 2, e + 1))  # neighbours swapped
        return found
