"""Fixed word lists of the four languages and a guess of a text's language from them."""

from __future__ import annotations

import re
from collections import Counter

#: Frequent function words.
FUNCTION_WORDS = {
    "en": "the a an and or but of to in on at by for from with without that this these those is are was were be been has have had do does did it its he she we they you i my our your his her their as if so then than because after before while when where which who whose what why how not no nor never there would can could should will must into near behind under over between until both all every some more most less just about any".split(),
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber doch nicht kein keine ist sind war waren wird wurde hat haben er sie es wir ihr ich du mein meine unser unsere sein seine zu zum zur in im am an auf aus bei mit nach von vor für über unter hinter neben gegen ohne während weil als wenn dann danach dass wie was wer kurz sich noch auch nur".split(),
    "es": "el la los las un una unos unas y o pero ni no es son era fue ha han de del al a en con sin por para sobre entre que se su sus mi mis nuestro nuestra lo le les yo tú él ella ellos como cuando donde mientras luego después antes detrás debajo cerca junto durante porque si ya muy más este esta ese hasta frente".split(),
    "fr": "le la les un une des du de et ou mais ni ne pas plus est sont était a ont il elle ils elles je tu nous vous on mon ma mes notre nos votre son sa ses ce cette ces à au aux en dans sur sous avec sans pour par que qui dont où comme quand puis ensuite avant après pendant tandis vers près derrière devant chez si y se".split(),
}
LANGUAGES = tuple(FUNCTION_WORDS)
_SETS = {lang: frozenset(words) for lang, words in FUNCTION_WORDS.items()}
#: Function words of any of the languages.
ANY = frozenset().union(*_SETS.values())
#: Words that only one of the languages has, which tell more than shared ones.
OWN = {lang: words - frozenset().union(*(w for other, w in _SETS.items() if other != lang)) for lang, words in _SETS.items()}

WORD = re.compile(r"[^\W\d_]+")


#: For each function word, what it counts for each language.
_WEIGHT = {w: tuple((w in _SETS[lang]) + (w in OWN[lang]) for lang in LANGUAGES) for w in ANY}


def language_counts(words: list[str]) -> dict[str, float]:
    """For each language, its function words among `words` (lower case), own ones counting double."""
    total = [0] * len(LANGUAGES)
    for w, n in Counter(filter(ANY.__contains__, words)).items():
        for i, x in enumerate(_WEIGHT[w]):
            total[i] += n * x
    return dict(zip(LANGUAGES, total, strict=True))


def guess_language(words: list[str], least: float = 3.0, lead: float = 1.5) -> str | None:
    """The language with the most function words, if there are enough of them and clearly more than of any other."""
    counts = sorted(((n, lang) for lang, n in language_counts(words).items()), reverse=True)
    (best, lang), (second, _) = counts[0], counts[1]
    return lang if best >= least and best >= lead * second else None
