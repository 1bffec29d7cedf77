"""Search terms as stems: folded words without stop words, each by its English and its French stem.

The stemmers follow the published Snowball descriptions (English, also known as Porter 2, and French): a word has regions, and
rules of suffixes act in turn, the longest suffix of a rule set first. They work on words, not texts; `analyze` keeps the
stems of words it has met.
"""

import re
import unicodedata
from functools import lru_cache

# Words that search leaves out, folded.
FRENCH_STOP_WORDS = (
    "a au aux avec c ce ces cet cette d dans de des du elle elles en es est et etre ete eu eux il ils j je l la le les leur leurs lui m ma mais me meme mes "
    "moi mon n ne nos notre nous on ou par pas pour qu que quel quelle qui s sa sans se ses si son sont sur t ta te tes toi ton tu un une vos votre vous y"
).split()
ENGLISH_STOP_WORDS = (
    "a an and are as at be been being but by can could did do does for from had has have he her his i if in into is it its me my no nor not of on or our she so such than "
    "that the their them then there these they this those to too was we were what when which who will with you your"
).split()
# Letters that decomposition does not take apart.
LETTERS = {"œ": "oe", "æ": "ae", "ß": "ss", "ø": "o", "đ": "d", "ł": "l"}
STOP_WORDS = frozenset(FRENCH_STOP_WORDS + ENGLISH_STOP_WORDS)
_TOKEN = re.compile(r"[^\W_]+")
_LETTERS = str.maketrans(LETTERS)


def fold(text: str) -> str:
    """Lower case without marks, ligatures spelled out."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower().translate(_LETTERS)) if not unicodedata.combining(c))


def tokens(text: str) -> list[str]:
    """Folded words without stop words, in order."""
    return [t for t in _TOKEN.findall(fold(text)) if t not in STOP_WORDS]


def analyze(text: str) -> tuple[list[str], int]:
    """The stems of a text, each as often as it stands there, and the number of its words."""
    words = tokens(text)
    return [s for w in words for s in stems(w)], len(words)


@lru_cache(maxsize=1 << 16)
def stems(word: str) -> tuple[str, ...]:
    """The French and the English stem of a folded word; one if they agree."""
    return tuple(dict.fromkeys(s for s in (french(word), english(word)) if s))


def _after(word: str, vowels: str, start: int = 0) -> int:
    """Where the region after the first non-vowel that follows a vowel begins."""
    m = re.compile(f"[{vowels}][^{vowels}]").search(word, start)
    return m.end() if m else len(word)


def _longest(word: str, suffixes, region: int = 0) -> str | None:
    """The longest of the suffixes that the word has from `region` on."""
    return max((s for s in suffixes if word.endswith(s) and len(word) - len(s) >= region), key=len, default=None)


# English ------------------------------------------------------------------------------------------------------------------------

# Fixed values of the published algorithm: words with stems of their own, suffixes and what they become.
_EN = "aeiouy"
_EN_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_EN_KEPT = "sky news howe atlas cosmos bias andes".split()
_EN_KEPT_1A = "inning outing canning herring earring proceed exceed succeed".split()
_EN_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_EN_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_EN_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()


def _short_end(w: str) -> bool:
    return bool(re.search(r"(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$", w))


def english(word: str) -> str:
    if len(word) < 3 or word in _EN_KEPT:
        return word
    if word in _EN_WHOLE:
        return _EN_WHOLE[word]
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    begin = re.match("gener|commun|arsen", w)
    r1 = begin.end() if begin else _after(w, _EN)
    r2 = _after(w, _EN, r1)
    vowel = lambda s: re.search("[aeiouy]", s)

    found = _longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if found == "sses":
        w = w[:-2]
    elif found in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif found == "s" and vowel(w[:-2]):
        w = w[:-1]
    if w in _EN_KEPT_1A:
        return w

    found = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if found in ("eed", "eedly"):
        if len(w) - len(found) >= r1:
            w = w[: -len(found)] + "ee"
    elif found and vowel(w[: -len(found)]):
        w = w[: -len(found)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif len(w) <= r1 and _short_end(w):
            w += "e"
    w = re.sub(r"(?<=.[^aeiouy])[yY]$", "i", w)

    found = _longest(w, _EN_2)
    if found and len(w) - len(found) >= r1:
        stem = w[: -len(found)]
        if found == "ogi" and not stem.endswith("l") or found == "li" and not re.search("[cdeghkmnrt]$", stem):
            found = None
        w = stem + _EN_2[found] if found else w
    found = _longest(w, _EN_3)
    if found and len(w) - len(found) >= (r2 if found == "ative" else r1):
        w = w[: -len(found)] + _EN_3[found]
    found = _longest(w, _EN_4)
    if found and len(w) - len(found) >= r2 and (found != "ion" or re.search("[st]ion$", w)):
        w = w[: -len(found)]
    if w.endswith("e") and (len(w) > r2 or len(w) > r1 and not _short_end(w[:-1])) or w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.replace("Y", "y")


# French -------------------------------------------------------------------------------------------------------------------------

_FR = "aeiouyâàëéêèïîôûù"
_FR_STANDARD = (
    "ance iqUe isme able iste eux ances iqUes ismes ables istes atrice ateur ation atrices ateurs ations logie logies usion ution usions utions ence ences ement ements ité ités "
    "if ive ifs ives eaux aux euse euses issement issements amment emment ment ments"
).split()
_FR_I_VERBS = (
    "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses "
    "issez issiez issions issons it"
).split()
_FR_VERBS = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
_FR_A_VERBS = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()


class _French:
    """One word on its way through the rules."""

    def __init__(self, word: str):
        w = re.sub(rf"(?<=[{_FR}])u(?=[{_FR}])|(?<=q)u", "U", word)
        w = re.sub(rf"(?<=[{_FR}])i(?=[{_FR}])", "I", w)
        self.w = re.sub(rf"(?<=[{_FR}])y|y(?=[{_FR}])", "Y", w)
        if re.match(rf"[{_FR}]{{2}}.|par|col|tap", self.w):
            self.rv = 3
        else:
            m = re.compile(f"[{_FR}]").search(self.w, 1)
            self.rv = m.end() if m else len(self.w)
        self.r1 = _after(self.w, _FR)
        self.r2 = _after(self.w, _FR, self.r1)

    def cut(self, suffix: str, region: int, put: str = "") -> bool:
        """Replaces a suffix that lies in the region."""
        at = len(self.w) - len(suffix)
        ok = self.w.endswith(suffix) and at >= region
        if ok:
            self.w = self.w[:at] + put
        return ok

    def cut_or(self, suffix: str, put: str) -> None:
        """Cuts a suffix in R2, else puts something in its place."""
        if self.w.endswith(suffix) and not self.cut(suffix, self.r2):
            self.w = self.w[: -len(suffix)] + put

    def standard(self) -> bool:
        s, r1, r2, rv = _longest(self.w, _FR_STANDARD), self.r1, self.r2, self.rv
        if s is None:
            return False
        if s.startswith(("atrice", "ateur", "ation")):
            if not self.cut(s, r2):
                return False
            self.cut_or("ic", "iqU")
            return True
        if s.startswith("logie"):
            return self.cut(s, r2, "log")
        if s.startswith(("usion", "ution")):
            return self.cut(s, r2, "u")
        if s.startswith("ence"):
            return self.cut(s, r2, "ent")
        if s in ("ement", "ements"):
            if not self.cut(s, rv):
                return False
            if self.w.endswith("iv"):
                if self.cut("iv", r2):
                    self.cut("at", r2)
            elif self.w.endswith("eus"):
                if not self.cut("eus", r2):
                    self.cut("eus", r1, "eux")
            elif self.w.endswith(("abl", "iqU")):
                self.cut(self.w[-3:], r2)
            elif self.w.endswith(("ièr", "Ièr")):
                self.cut(self.w[-3:], rv, "i")
            return True
        if s in ("ité", "ités"):
            if not self.cut(s, r2):
                return False
            if self.w.endswith("abil"):
                self.cut_or("abil", "abl")
            elif self.w.endswith("ic"):
                self.cut_or("ic", "iqU")
            else:
                self.cut("iv", r2)
            return True
        if s in ("if", "ive", "ifs", "ives"):
            if not self.cut(s, r2):
                return False
            if self.cut("at", r2):
                self.cut_or("ic", "iqU")
            return True
        if s == "eaux":
            return self.cut(s, 0, "eau")
        if s == "aux":
            return self.cut(s, r1, "al")
        if s in ("euse", "euses"):
            return self.cut(s, r2) or self.cut(s, r1, "eux")
        if s.startswith("issement"):
            return bool(re.search(f"[^{_FR}]$", self.w[: -len(s)])) and self.cut(s, r1)
        if s in ("amment", "emment"):
            self.cut(s, rv, "ant" if s[0] == "a" else "ent")
            return False  # verb endings are tried as well
        if s in ("ment", "ments"):
            before = len(self.w) - len(s) - 1
            if before >= rv and self.w[before] in _FR:
                self.cut(s, rv)
            return False
        return self.cut(s, r2)

    def verb(self) -> bool:
        s = _longest(self.w, _FR_I_VERBS, self.rv)
        before = len(self.w) - len(s) - 1 if s else -1
        if s and before >= self.rv and self.w[before] not in _FR:
            return self.cut(s, self.rv)
        s = _longest(self.w, ["ions", *_FR_VERBS, *_FR_A_VERBS], self.rv)
        if s is None:
            return False
        if s == "ions":
            return self.cut(s, self.r2)
        self.cut(s, self.rv)
        if s in _FR_A_VERBS:
            self.cut("e", self.rv)
        return True

    def residual(self) -> None:
        if re.search(r"[^aiouès]s$", self.w):
            self.w = self.w[:-1]
        s = _longest(self.w, "ion ier ière Ier Ière e ë".split(), self.rv)
        if s == "ion":
            if re.search("[st]ion$", self.w) and len(self.w) - 4 >= self.rv:
                self.cut(s, self.r2)
        elif s == "e":
            self.cut(s, self.rv)
        elif s == "ë":
            if self.w.endswith("guë"):
                self.cut(s, self.rv)
        elif s:
            self.cut(s, self.rv, "i")


def french(word: str) -> str:
    x = _French(word)
    if x.standard() or x.verb():
        x.w = re.sub("Y$", "i", x.w)
        x.w = re.sub("ç$", "c", x.w)
    else:
        x.residual()
    w = re.sub(r"(enn|onn|ett|ell|eill)$", lambda m: m[0][:-1], x.w)
    w = re.sub(rf"[éè](?=[^{_FR}]+$)", "e", w)
    return w.translate(str.maketrans("IUY", "iuy"))
