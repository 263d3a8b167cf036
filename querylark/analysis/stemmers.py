"""Suffix stripping after the published Snowball descriptions (English, German, French, Spanish, Italian, Portuguese), the folded
variants, and Croatian by suffix rules with a pluggable lexicon."""

from __future__ import annotations

import re
from collections.abc import Callable


def _after(word: str, vowels: str, start: int = 0) -> int:
    """Where the region after the first non-vowel that follows a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in vowels and word[i - 1] in vowels:
            return i + 1
    return len(word)


def _rv(word: str, vowels: str) -> int:
    """Romance RV: by the first two letters."""
    if len(word) < 3:
        return len(word)
    if word[1] not in vowels:
        return next((i + 1 for i in range(2, len(word)) if word[i] in vowels), len(word))
    if word[0] in vowels:
        return next((i + 1 for i in range(2, len(word)) if word[i] not in vowels), len(word))
    return 3


def _longest(word: str, suffixes: str, region: int = 0) -> str:
    """The longest of the suffixes that the word ends in, if it lies in the region; '' otherwise."""
    found = max((s for s in suffixes.split() if word.endswith(s)), key=len, default="")
    return found if found and len(word) - len(found) >= region else ""


# ---- English (Porter 2)

_EN_V = "aeiouy"
_EN_WHOLE = dict(p.split("=") for p in "skis=ski skies=sky dying=die lying=lie tying=tie idly=idl gently=gentl ugly=ugli early=earli only=onli singly=singl sky=sky news=news howe=howe atlas=atlas cosmos=cosmos bias=bias andes=andes".split())
_EN_AFTER_1A = set("inning outing canning herring earring proceed exceed succeed".split())
_EN_2 = dict(p.split("=") for p in "tional=tion enci=ence anci=ance abli=able entli=ent izer=ize ization=ize ational=ate ation=ate ator=ate alism=al aliti=al alli=al fulness=ful ousli=ous ousness=ous iveness=ive iviti=ive biliti=ble bli=ble fulli=ful lessli=less".split())
_EN_3 = dict(p.split("=") for p in "tional=tion ational=ate alize=al icate=ic iciti=ic ical=ic ful= ness=".split())


def _en_short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _EN_V and w[1] not in _EN_V
    return len(w) > 2 and w[-1] not in _EN_V + "wxY" and w[-2] in _EN_V and w[-3] not in _EN_V


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in _EN_WHOLE:
        return _EN_WHOLE[word]
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    pre = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(pre) if pre else _after(w, _EN_V)
    r2 = _after(w, _EN_V, r1)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy].", w[:-1]) and any(c in _EN_V for c in w[:-2]):
        w = w[:-1]
    if w in _EN_AFTER_1A:
        return w
    s = _longest(w, "eed eedly ed edly ing ingly")
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and any(c in _EN_V for c in w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif r1 >= len(w) and _en_short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _EN_V:
        w = w[:-1] + "i"
    s = _longest(w, " ".join(_EN_2) + " ogi li")
    if s and len(w) - len(s) >= r1:
        if s == "ogi":
            w = w[:-1] if w.endswith("logi") else w
        elif s == "li":
            w = w[:-2] if w[-3:-2] in tuple("cdeghkmnrt") else w
        else:
            w = w[: -len(s)] + _EN_2[s]
    s = _longest(w, " ".join(_EN_3) + " ative")
    if s and len(w) - len(s) >= r1:
        if s == "ative":
            w = w[:-5] if len(w) - 5 >= r2 else w
        else:
            w = w[: -len(s)] + _EN_3[s]
    s = _longest(w, "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion")
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _en_short_end(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


# ---- German

_DE_V = "aeiouyäöü"


def german(word: str) -> str:
    w = word.replace("ß", "ss")
    w = re.sub(f"(?<=[{_DE_V}])u(?=[{_DE_V}])", "U", w)
    w = re.sub(f"(?<=[{_DE_V}])y(?=[{_DE_V}])", "Y", w)
    r1 = max(3, _after(w, _DE_V)) if len(w) > 3 else len(w)
    r2 = _after(w, _DE_V, _after(w, _DE_V))
    s = _longest(w, "em ern er e en es s", r1)
    if s and (s != "s" or w[-2:-1] in tuple("bdfghklmnrt")):
        w = w[: -len(s)]
        if s in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    s = _longest(w, "en er est st", r1)
    if s and (s != "st" or w[-3:-2] in tuple("bdfghklmnt") and len(w) >= 6):
        w = w[: -len(s)]
    s = _longest(w, "end ung ig ik isch lich heit keit", r2)
    if s in ("end", "ung"):
        w = w[:-3]
        if w.endswith("ig") and not w.endswith("eig") and len(w) - 2 >= r2:
            w = w[:-2]
    elif s in ("ig", "ik", "isch"):
        w = w if w[: -len(s)].endswith("e") else w[: -len(s)]
    elif s in ("lich", "heit"):
        w = w[:-4]
        if w.endswith(("er", "en")) and len(w) - 2 >= r1:
            w = w[:-2]
    elif s == "keit":
        w = w[:-4]
        t = _longest(w, "lich ig", r2)
        w = w[: -len(t)] if t else w
    return w.lower().translate(str.maketrans("äöü", "aou"))


# ---- French

_FR_V = "aeiouyâàëéêèïîôûù"


def french(word: str) -> str:
    w = re.sub(f"(?<=[{_FR_V}])([ui])(?=[{_FR_V}])|(?<=q)(u)", lambda m: m[0].upper(), word)
    w = re.sub(f"(?<=[{_FR_V}])y|y(?=[{_FR_V}])", "Y", w)
    if re.match(f"(par|col|tap)|[{_FR_V}][{_FR_V}]", w):
        rv = 3
    else:
        rv = next((i + 1 for i in range(1, len(w)) if w[i] in _FR_V), len(w))
    r1 = _after(w, _FR_V)
    r2 = _after(w, _FR_V, r1)
    begun, verb = w, True

    def cut(s: str, put: str = "") -> str:
        return w[: len(w) - len(s)] + put

    s = _longest(w, "ance iqUe isme able iste eux ances iqUes ismes ables istes atrice ateur ation atrices ateurs ations logie logies usion ution usions utions ence ences ement ements ité ités if ive ifs ives eaux aux euse euses issement issements amment emment ment ments")
    at = len(w) - len(s)
    if s:
        verb = False
        if s in "ance iqUe isme able iste eux ances iqUes ismes ables istes".split() and at >= r2:
            w = cut(s)
        elif s in "atrice ateur ation atrices ateurs ations".split() and at >= r2:
            w = cut(s)
            if w.endswith("ic"):
                w = cut("ic", "" if len(w) - 2 >= r2 else "iqU")
        elif s in ("logie", "logies") and at >= r2:
            w = cut(s, "log")
        elif s in ("usion", "ution", "usions", "utions") and at >= r2:
            w = cut(s, "u")
        elif s in ("ence", "ences") and at >= r2:
            w = cut(s, "ent")
        elif s in ("ement", "ements") and at >= rv:
            w = cut(s)
            t = _longest(w, "iv eus abl iqU ièr Ièr")
            if t == "iv" and len(w) - 2 >= r2:
                w = cut(t)
                w = cut("at") if w.endswith("at") and len(w) - 2 >= r2 else w
            elif t == "eus":
                w = cut(t) if len(w) - 3 >= r2 else cut(t, "eux") if len(w) - 3 >= r1 else w
            elif t in ("abl", "iqU") and len(w) - 3 >= r2:
                w = cut(t)
            elif t in ("ièr", "Ièr") and len(w) - 3 >= rv:
                w = cut(t, "i")
        elif s in ("ité", "ités") and at >= r2:
            w = cut(s)
            t = _longest(w, "abil ic iv")
            if t == "abil":
                w = cut(t) if len(w) - 4 >= r2 else cut(t, "abl")
            elif t == "ic":
                w = cut(t) if len(w) - 2 >= r2 else cut(t, "iqU")
            elif t == "iv" and len(w) - 2 >= r2:
                w = cut(t)
        elif s in ("if", "ive", "ifs", "ives") and at >= r2:
            w = cut(s)
            if w.endswith("at") and len(w) - 2 >= r2:
                w = cut("at")
                if w.endswith("ic"):
                    w = cut("ic") if len(w) - 2 >= r2 else cut("ic", "iqU")
        elif s == "eaux":
            w = cut(s, "eau")
        elif s == "aux" and at >= r1:
            w = cut(s, "al")
        elif s in ("euse", "euses"):
            w = cut(s) if at >= r2 else cut(s, "eux") if at >= r1 else w
        elif s in ("issement", "issements") and at >= r1 and w[at - 1 : at] not in tuple(_FR_V):
            w = cut(s)
        elif s == "amment" and at >= rv:
            w, verb = cut(s, "ant"), True
        elif s == "emment" and at >= rv:
            w, verb = cut(s, "ent"), True
        elif s in ("ment", "ments") and at - 1 >= rv and w[at - 1] in _FR_V:
            w, verb = cut(s), True
        elif w == begun:
            verb = True
    changed = w != begun
    if verb or not changed:
        before = w
        s = _longest(w, "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it", rv)
        if s and w[len(w) - len(s) - 1 : len(w) - len(s)] not in tuple(_FR_V) and len(w) - len(s) - 1 >= rv:
            w = cut(s)
        else:
            s = _longest(w, "ions é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions", rv)
            if s == "ions":
                w = cut(s) if len(w) - 4 >= r2 else w
            elif s in "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split():
                w = cut(s)
                w = cut("e") if w.endswith("e") and len(w) - 1 >= rv else w
            elif s:
                w = cut(s)
        changed = changed or w != before
        if w == before and not (begun != before):
            changed = False
    if changed:
        w = w[:-1] + "i" if w.endswith("Y") else w[:-1] + "c" if w.endswith("ç") else w
    else:
        if w.endswith("s") and w[-2:-1] not in tuple("aiouès"):
            w = w[:-1]
        s = _longest(w, "ion ier ière Ier Ière e ë", rv)
        if s == "ion":
            w = cut(s) if len(w) - 3 >= r2 and w[-4:-3] in ("s", "t") else w
        elif s in ("ier", "ière", "Ier", "Ière"):
            w = cut(s, "i")
        elif s == "e" or s == "ë" and w.endswith("guë"):
            w = cut(s)
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    w = re.sub(f"[éè](?=[^{_FR_V}]+$)", "e", w)
    return w.lower()


# ---- Spanish, Italian, Portuguese

_ES_V = "aeiouáéíóúü"
_ES_PLAIN = str.maketrans("áéíóú", "aeiou")


def spanish(w: str) -> str:
    rv = _rv(w, _ES_V)
    r1 = _after(w, _ES_V)
    r2 = _after(w, _ES_V, r1)
    s = _longest(w, "me se sela selo selas selos la le lo las les los nos", rv)
    if s:
        stem = w[: -len(s)]
        t = _longest(stem, "iéndo ándo ár ér ír ando iendo ar er ir yendo", rv)
        if t and (t != "yendo" or stem.endswith("uyendo")):
            w = stem[: -len(t)] + t.translate(_ES_PLAIN)
    begun = w
    s = _longest(w, "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos adora ador ación adoras adores aciones ante antes ancia ancias logía logías ución uciones encia encias amente mente idad idades iva ivo ivas ivos")
    at = len(w) - len(s)
    if s in "adora ador ación adoras adores aciones ante antes ancia ancias".split() and at >= r2:
        w = w[:at]
        w = w[:-2] if w.endswith("ic") and len(w) - 2 >= r2 else w
    elif s in ("logía", "logías") and at >= r2:
        w = w[:at] + "log"
    elif s in ("ución", "uciones") and at >= r2:
        w = w[:at] + "u"
    elif s in ("encia", "encias") and at >= r2:
        w = w[:at] + "ente"
    elif s == "amente" and at >= r1:
        w = w[:at]
        t = _longest(w, "iv os ic ad", r2)
        w = w[: -len(t)] if t else w
        w = w[:-2] if t == "iv" and w.endswith("at") and len(w) - 2 >= r2 else w
    elif s in ("mente", "idad", "idades", "iva", "ivo", "ivas", "ivos") and at >= r2:
        w = w[:at]
        t = _longest(w, {"mente": "ante able ible", "idad": "abil ic iv", "idades": "abil ic iv"}.get(s, "at"), r2)
        w = w[: -len(t)] if t else w
    elif s and s not in ("amente",) and at >= r2:
        w = w[:at]
    if w == begun:
        s = _longest(w, "ya ye yan yen yeron yendo yo yó yas yes yais yamos", rv)
        if s and w[: -len(s)].endswith("u"):
            w = w[: -len(s)]
        else:
            s = _longest(w, "en es éis emos", rv)
            t = _longest(w, "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos", rv)
            if t and len(t) >= len(s):
                w = w[: -len(t)]
            elif s:
                w = w[: -len(s)]
                w = w[:-1] if w.endswith("gu") else w
    s = _longest(w, "os a o á í ó", rv)
    if s:
        w = w[: -len(s)]
    else:
        s = _longest(w, "e é", rv)
        if s:
            w = w[:-1]
            w = w[:-1] if w.endswith("gu") and len(w) - 1 >= rv else w
    return w.translate(_ES_PLAIN)


_IT_V = "aeiouàèìòù"


def italian(word: str) -> str:
    w = word.translate(str.maketrans("áéíóú", "àèìòù"))
    w = re.sub("qu", "qU", w)
    w = re.sub(f"(?<=[{_IT_V}])[ui](?=[{_IT_V}])", lambda m: m[0].upper(), w)
    rv = _rv(w, _IT_V)
    r1 = _after(w, _IT_V)
    r2 = _after(w, _IT_V, r1)
    s = _longest(w, "ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene", rv)
    if s:
        stem = w[: -len(s)]
        if _longest(stem, "ando endo", rv):
            w = stem
        elif _longest(stem, "ar er ir", rv):
            w = stem + "e"
    begun = w
    s = _longest(w, "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti azione azioni atore atori logia logie uzione uzioni usione usioni enza enze amento amenti imento imenti amente ità ivo ivi iva ive")
    at = len(w) - len(s)
    if s in ("azione", "azioni", "atore", "atori") and at >= r2:
        w = w[:at]
        w = w[:-2] if w.endswith("ic") and len(w) - 2 >= r2 else w
    elif s in ("logia", "logie") and at >= r2:
        w = w[:at] + "log"
    elif s in ("uzione", "uzioni", "usione", "usioni") and at >= r2:
        w = w[:at] + "u"
    elif s in ("enza", "enze") and at >= r2:
        w = w[:at] + "ente"
    elif s in ("amento", "amenti", "imento", "imenti"):
        w = w[:at] if at >= rv else w
    elif s == "amente":
        if at >= r1:
            w = w[:at]
            t = _longest(w, "iv os ic abil", r2)
            w = w[: -len(t)] if t else w
            w = w[:-2] if t == "iv" and w.endswith("at") and len(w) - 2 >= r2 else w
    elif s in ("ità", "ivo", "ivi", "iva", "ive") and at >= r2:
        w = w[:at]
        t = _longest(w, "abil ic iv" if s == "ità" else "at", r2)
        w = w[: -len(t)] if t else w
        w = w[:-2] if t == "at" and w.endswith("ic") and len(w) - 2 >= r2 else w
    elif s and at >= r2:
        w = w[:at]
    if w == begun:
        s = _longest(w, "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero ete eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir", rv)
        w = w[: -len(s)] if s else w
    if len(w) - 1 >= rv and w[-1:] in tuple("aeioàèìò"):
        w = w[:-1]
        if w.endswith("i") and len(w) - 1 >= rv:
            w = w[:-1]
    if w.endswith(("ch", "gh")) and len(w) - 1 >= rv:
        w = w[:-1]
    return w.lower()


_PT_V = "aeiouáéíóúâêô"


def portuguese(word: str) -> str:
    w = word.replace("ã", "a~").replace("õ", "o~")
    rv = _rv(w, _PT_V)
    r1 = _after(w, _PT_V)
    r2 = _after(w, _PT_V, r1)
    begun = w
    s = _longest(w, "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância logia logias uça~o uço~es ência ências amente mente idade idades iva ivo ivas ivos ira iras")
    at = len(w) - len(s)
    if s in ("logia", "logias") and at >= r2:
        w = w[:at] + "log"
    elif s in ("uça~o", "uço~es") and at >= r2:
        w = w[:at] + "u"
    elif s in ("ência", "ências") and at >= r2:
        w = w[:at] + "ente"
    elif s == "amente" and at >= r1:
        w = w[:at]
        t = _longest(w, "iv os ic ad", r2)
        w = w[: -len(t)] if t else w
        w = w[:-2] if t == "iv" and w.endswith("at") and len(w) - 2 >= r2 else w
    elif s in ("mente", "idade", "idades", "iva", "ivo", "ivas", "ivos") and at >= r2:
        w = w[:at]
        t = _longest(w, {"mente": "ante avel ível", "idade": "abil ic iv", "idades": "abil ic iv"}.get(s, "at"), r2)
        w = w[: -len(t)] if t else w
    elif s in ("ira", "iras"):
        w = w[:at] + "ir" if at >= rv and w[at - 1 : at] == "e" else w
    elif s and at >= r2 and s != "amente":
        w = w[:at]
    verb = w == begun
    if verb:
        s = _longest(w, "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras", rv)
        w = w[: -len(s)] if s else w
    if w != begun:
        w = w[:-1] if w.endswith("ci") and len(w) - 1 >= rv else w
    else:
        s = _longest(w, "os a i o á í ó", rv)
        w = w[: -len(s)] if s else w
    s = _longest(w, "e é ê", rv)
    if s:
        w = w[:-1]
        w = w[:-1] if w.endswith(("gu", "ci")) and len(w) - 1 >= rv else w
    elif w.endswith("ç"):
        w = w[:-1] + "c"
    return w.replace("a~", "ã").replace("o~", "õ")


# ---- repairs around them

def italian_repaired(w: str) -> str:
    if w.endswith(("trice", "trici")) and len(w) > 7:
        w = w[:-5] + "tore"
    if w.endswith(("iano", "iana", "iani", "iane")) and len(w) > 6:
        w = w[:-4] + "iano"
    s = italian(w)
    return s[:-1] if len(s) > 4 and s[-1] in "aeio" else s


_PT_PLURAL = (("ões", "ão"), ("ães", "ão"), ("ais", "al"), ("éis", "el"), ("eis", "el"), ("óis", "ol"), ("res", "r"), ("zes", "z"), ("ns", "m"), ("s", ""))


def portuguese_repaired(w: str) -> str:
    if len(w) > 3 and w.endswith("s") and not w.endswith("ss"):
        for a, b in _PT_PLURAL:
            if w.endswith(a) and len(w) - len(a) >= 2:
                w = w[: len(w) - len(a)] + b
                break
    if w.endswith(("ona", "ora")) and len(w) > 5:
        w = w[:-1]
    return portuguese(w)


_RESTORED = {"es": dict(zip("cion sion logia mente ia".split(), "ción sión logía mente ía".split())), "fr": dict(zip("ite iere erent".split(), "ité ière èrent".split())), "pt": dict(zip("cao coes avel ivel encia ancia".split(), "ção ções ável ível ência ância".split()))}


def restore(w: str, lang: str) -> str:
    """The accent that folding took from a known suffix; the longest suffix wins."""
    s = max((s for s in _RESTORED[lang] if w.endswith(s) and len(w) > len(s) + 1), key=len, default="")
    return w[: -len(s)] + _RESTORED[lang][s] if s else w


def german_plain(w: str) -> str:
    """ae, oe and ue as the plain vowel; ue not after a vowel or q."""
    w = w.replace("ae", "a").replace("oe", "o")
    return re.sub("(?<![aeiouq])ue", "u", w)


_CYRILLIC = dict(zip("абвгдђежзијклљмнњопрстћуфхцчџш", "a b v g d đ e ž z i j k l lj m n nj o p r s t ć u f h c č dž š".split()))
LEXICON: dict[str, str] = {}
_HR_SUFFIXES = "ovima evima ijega ijemu ijima ama ima oga omu ega emu ovi eva ove ova ući ala ale ali alo ila ile ili ilo og om em im ih oj ga mu je ju ao io ti te mo la le li lo a e i o u".split()


def croatian(w: str) -> str:
    """Cyrillic to Latin, then the lexicon, else the longest suffix that leaves three letters with a vowel."""
    w = "".join(_CYRILLIC.get(c, c) for c in w)
    if w in LEXICON:
        return LEXICON[w]
    for s in sorted(_HR_SUFFIXES, key=len, reverse=True):
        if w.endswith(s) and len(w) - len(s) >= 3 and any(c in "aeiour" for c in w[: -len(s)]):
            return w[: -len(s)]
    return w


def chains(fold: Callable[[str], str]) -> dict[str, Callable[[str], str]]:
    """Tokenizer names and what they do to a term."""
    return {
        "en_stem": english, "de_stem": german, "es_stem": spanish, "fr_stem": french, "it_stem": italian_repaired, "pt_stem": portuguese_repaired, "hr_stem": croatian,
        "it_stem_fold": lambda w: italian_repaired(fold(w)), "es_stem_fold": lambda w: fold(spanish(restore(fold(w), "es"))), "fr_stem_fold": lambda w: fold(french(restore(fold(w), "fr"))),
        "pt_stem_fold": lambda w: fold(portuguese_repaired(restore(fold(w), "pt"))), "de_stem_fold": lambda w: german(german_plain(fold(w))), "hr_stem_fold": lambda w: fold(croatian(fold("".join(_CYRILLIC.get(c, c) for c in w)))),
    }
