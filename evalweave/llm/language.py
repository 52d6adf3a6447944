"""Which human language a text is written in, by its function words."""

from __future__ import annotations

import re

#: Frequent function words of some languages.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for on with as are this be by from or an at which you not have when each all if then we can may must there its into than whose only after before until between into do does will would should could about what how i my me your their they he she us let",
    "de": "der die das und ist ein eine einen einem einer den dem des von zu mit nicht sich auf für wird werden nur jedes jeden weil wir man nach am falls danach durch als auch aus bei oder noch wenn dass niemals kein keine zuerst einmal",
    "fr": "le la les de du des un une et est que qui dans pour par sur pas ne en au aux il nous lorsque car chaque puis ce cette avec se son sa ses plus ou mais si aucun d'abord seule fois on suffit",
    "es": "el la los las de del en un una unos y que con por para no se al cuando sola después porque ningún lo su sus es son más pero como sin sobre entre hasta basta vez cada primero",
    "pt": "o a os as de do da dos das em na nos nas um uma e que com por para pelo pela não ao quando apenas depois porque nenhum até se sua seu mais mas como sem sobre entre basta vez cada primeiro fim foi é",
    "it": "il lo la i gli le di del della che e un una per con non si da sono quando poi dei delle nel nella al alla più ma come senza ogni solo perché nessun basta volta prima",
    "nl": "de het een en van is dat niet op te voor met als zijn wordt door naar aan bij ook maar uit dan nog geen elke eerst omdat wij alleen",
    "pl": "i w na z do się nie jest to że o jak po dla gdy potem tylko raz każdy każde ponieważ żaden lub od przez są być oraz ale najpierw wystarczy od który która które",
}
WORDS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_LETTERS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_IDENTIFIER = re.compile(r"\w*(?:_|\d)\w*|\w+\.\w+|\b[a-z]+[A-Z]\w*")


def words(text: str) -> list[str]:
    """Lower-cased words of letters only; identifiers and numbers are left out."""
    return [w.lower() for w in _LETTERS.findall(_IDENTIFIER.sub(" ", text))]


def language(text: str, least_share: float = 0.12) -> str | None:
    """The language whose function words are the largest share of the words, or None where no language has enough.

    A script other than Latin is ``other``. Latin letters beyond ASCII, which English does without, count against English.
    """
    found = words(text)
    if not found:
        return None
    joined = "".join(found)
    if sum(ch > "ɏ" for ch in joined) > 0.3 * len(joined):
        return "other"
    accents = sum(ch > "\x7f" for ch in joined)
    hits = {k: sum(w in known for w in found) for k, known in WORDS.items()}
    hits["en"] -= 2 * accents
    best = max(hits, key=lambda k: (hits[k], k == "en"))
    return best if hits[best] >= max(1, least_share * len(found)) else None
