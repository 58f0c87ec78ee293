"""Names of people in four languages: no word of a text lost, no surname in clear."""

import random
import re

from prismill.llm import surrogates

TITLES = {
    "en": (["Mr", "Mr.", "Mrs.", "Ms", "Dr."], "Smith Jones Baker O’Neill Carter-Webb".split(), "John Paul Mary Jane".split()),
    "de": (["Herr", "Frau", "Herr Dr.", "Frau Prof. Dr."], "Müller Schmidt Köhler Groß Weiß".split(), "Anna Karl Jürgen Uta".split()),
    "fr": (["Monsieur", "Mme", "Madame"], ["Lefèvre", "de la Tour", "Dupont", "du Bois"], "Émile Jean-Luc Chloé".split()),
    "es": (["Señor", "Sra.", "Señora", "Sr."], ["López", "García", "de la Cruz", "Núñez"], "María José Íñigo".split()),
}
FRAMES = {
    "en": ["Yesterday {m} wrote a letter.", "We met {m} at noon, and {s} left soon.", "{m} paid. The bill came late."],
    "de": ["Gestern schrieb {m} einen Brief.", "Wir trafen {m} am Mittag, und {s} ging bald.", "Heute kam {m} Am Montag nicht."],
    "fr": ["Hier {m} a écrit une lettre.", "Nous avons vu {m} à midi, puis {s} est parti.", "{m} paie. La note vient tard."],
    "es": ["Ayer {m} escribió una carta.", "Vimos a {m} al mediodía, y {s} se fue pronto.", "{m} paga. La cuenta llega tarde."],
}


def made(seed, n):
    """Texts with the places of mentions as lists of what is text and what is a name."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(TITLES))
        titles, families, given = TITLES[lang]
        t, f = rng.choice(titles), rng.choice(families)
        g = " ".join(rng.sample(given, rng.choice([0, 1, 1, 2])))
        frame = rng.choice(FRAMES[lang])
        name = (g + " " + f).strip()
        plain = frame.replace("{m}", f"{t} \0").replace("{s}", "\0")
        out.append((i, frame.format(m=f"{t} {name}", s=f), plain.split("\0"), f, g))
    return out


def test_names_of_a_thousand_texts(spark):
    rows = made(3, 1000)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(7)
    got = {r.doc_id: r for r in surrogates.replaced(docs, "key").collect()}
    families = {}
    for i, _, parts, family, given in rows:
        whole = re.fullmatch("(.+?)".join(map(re.escape, parts)), got[i].text)
        assert whole, (rows[i][1], got[i].text)  # all words around stay, and nothing else
        assert got[i].n_entities == len(parts) - 1
        subs = whole.groups()
        for w in [*family.split()[-1:], *given.split()]:
            assert w not in re.split(r"[ ,.]", got[i].text), (rows[i][1], got[i].text)
        assert len(subs[0].split()) == (2 if given else 1)
        assert all(s == subs[0].split()[-1] for s in subs[1:])  # the same person
        families.setdefault(family.lower(), set()).add(subs[0].split()[-1])
    assert all(len(v) == 1 for v in families.values())  # one surrogate in all texts
    assert len(set.union(*families.values())) == len(families)  # and no two alike


def test_where_a_name_ends(spark):
    texts = {
        "Mr John Paul Smith left. Smith came.": ("Mr (\\S+) (\\S+) left\\. (\\S+) came\\.", 2),
        "Dear Herr Müller Am Montag geht es. Frau Anna Müller": ("Dear Herr (\\S+) Am Montag geht es\\. Frau \\S+ (\\S+)", 2),
        "Herr Müller Termin heute. Frau Müller kommt": ("Herr (\\S+) Termin heute\\. Frau (\\S+) kommt", 2),
        "Sra. María García López llegó": ("Sra\\. (\\S+) (\\S+) llegó", 1),
        "Mme de la Tour et Dr. van Helsing": ("Mme (\\S+) et Dr\\. (\\S+)", 2),
        "Mr J. R. Smith, J. R. Smith and Smith": ("Mr (\\S+) (\\S+), (?:\\S+ )*(\\S+) and (\\S+)", 3),
        "Prof. Dr. Anna Schmidt und Schmidt": ("Prof\\. Dr\\. (\\S+) (\\S+) und (\\S+)", 2),
        "Господин Пётр Иванов и Иванов": ("Господин (\\S+) (\\S+) и (\\S+)", 2),
        "Herr Am Montag": ("Herr Am Montag", 0),
        "Mr. " + "A" * 3000 + "a " + "Bb " * 500 + "ends": ("Mr\\. (\\S+) (\\S+) ends", 1),
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in surrogates.replaced(docs, "key").collect():
        text, (pattern, n) = list(texts.items())[r.doc_id]
        assert re.fullmatch(pattern, r.text) and r.n_entities == n, (text[:80], r.text[:80], r.n_entities)
        for name in ("Müller", "Smith", "García", "López", "María", "Tour", "Helsing", "Schmidt", "Иванов", "John", "Paul"):
            assert not re.search(rf"(?<!\w){name}(?!\w)", r.text), r.text
