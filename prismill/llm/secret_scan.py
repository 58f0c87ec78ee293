"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

Candidates are long runs of letters, digits and signs, quoted strings, values of
eight or more characters after a name with ":" or "=", and what stands between
a user's name and "@" in an address, what a password or token is said to be, and
private keys with their first and last line. An unquoted value ends at white space, a
quote or angle bracket, before the next "&name=" and before punctuation at its
end; one that is a URL or has a name and value of its own is looked at inside.
The forest looks at a candidate's length, the transitions between its characters,
how much of it dictionary words cover, the path it comes from and the words
around it. The dictionary is learned: the words that most documents of the corpus
have (``dictionary``), beside common words and endings looked for inside words. It is trained from labelled findings, given as a table or made by
``labelled_findings``, and then written as one column expression, so a scan is
a single pass of column functions over the texts: no shuffle, no Python.

Defined results
- null or empty text: no candidates; a null path is a path that says nothing
- texts of any length are scanned whole, all candidates of a text are judged
- repeated rows and null ids give findings of their own
- columns of the input are kept by ``redacted``; ``findings`` has only its own
- an empty table gives an empty table; labelled findings of one class only are an error
- a corpus without words has an empty dictionary, which covers nothing; of words of equal frequency the first by letters are in it
- a private key without its last line is looked at line by line
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismill.llm import spotting

#: An unquoted value's characters: punctuation only where more follows, and signs that part values not before a name.
_LAST = r"""[,;.:)\]}&?|]{0,8}(?:[\s"'<>]|$)"""
_VALUE = rf"""(?:[^\s"'<>,;.:)\]}}&?|]|[.:)\]}}](?!{_LAST})|[,;&?|](?!{_LAST}|[A-Za-z_][A-Za-z0-9_.\-]{{0,63}}[:=])){{8,}}+"""
#: Candidates: private keys, quoted strings without spaces, passwords before a host, values after a name or "is", web tokens with their dots, and runs of what keys are made of.
CANDIDATE = (
    r"""-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?:\s{0,8}[A-Za-z][A-Za-z0-9\-]{1,31}: [^\n\r]{0,256}){0,16}[A-Za-z0-9+/=\s\\]{16,}+-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"""
    r"""|(?<=["'])[^\s"']{8,}(?=["'])"""
    r"""|(?<=[A-Za-z0-9_.\-]:)(?<!(?i:pass|passwd|password|passphrase|pwd|secret|token|key):)[^\s:@/"'<>]{8,}+(?=@[A-Za-z0-9\[])"""
    rf"""|(?<=[:=>\s])(?<=[A-Za-z0-9_)\]"'\-][ \t]{{0,3}}[:=]{{1,2}}>?[ \t]{{0,3}})(?![=:>\s]|//|[A-Za-z][A-Za-z0-9+.\-]{{0,20}}://|[A-Za-z_][A-Za-z0-9_.\-]{{0,63}}[:=][^\s"'<>]{{8}}){_VALUE}"""
    rf"""|(?<=[st][ ])(?<=[ ](?i:is|ist|was)[ ])(?<=(?i:pass|passwd|password|passwort|passphrase|pwd|passcode|secret|token|key) (?i:is|ist|was) ){_VALUE}"""
    r"""|(?<![A-Za-z0-9+/_\-])eyJ[A-Za-z0-9_\-]{8,}+(?:\.[A-Za-z0-9_\-]{4,}+){1,2}"""
    r"""|(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{16,}={0,2}"""
)
#: What is looked at of the text around, in characters; and for words that speak for or against a secret.
BEFORE, AFTER, NEAR = 64, 32, 28
#: Characters that every candidate has at least.
LEAST = 8
TREES, DEPTH, SEED = 20, 6, 11
LABELLED = 6000
#: The dictionary has so many words at most.
WORDS = 1000
#: What counts as a word of the dictionary, in lower case.
WORD = r"(?<![\p{L}\p{M}0-9_])\p{L}{3,20}(?![\p{L}\p{M}0-9_])"
#: The words a name or value is made of, as in customerName, CUSTOMER_NAME or customer-name.
PIECE = r"\p{Lu}?\p{Ll}+|\p{Lu}+(?!\p{Ll})|\p{L}+"

#: Fixed: pairs of letters that are common in prose of Western European languages.
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ei ie sc un qu ue ai eu".split()
#: Fixed: words and endings looked for within a candidate.
DICTIONARY = (
    "the and for with that this from have not are was his her they been user name file path data value test example sample class function return string number index list item page view "
    "config default public private static service server client request response handler manager factory message event error debug info warning image style script format content header "
    "der die das und ist nicht ein eine mit von auf auch keit heit lich ung schaft les des une dans pour avec est sur qui que pas ment tion eau eux ción ado mente los las por para con una del como"
).split()
SECRET_WORDS = r"(?i)token|secret|passw|passphrase|pwd|api.?key|access.?key|private.?key|auth|bearer|credential|client.?key|signing"
HARMLESS_WORDS = r"(?i)commit|checksum|md5|sha-?\d|digest|uuid|guid|version|revision|isbn|etag|example(?!\.)|placeholder|your|dummy|fixture|https?:|href|src="
TEST_PATHS = r"(?i)test|example|sample|mock|fixture|docs?/|readme|vendor|node_modules"
CONFIG_PATHS = r"(?i)\.env|config|settings|secret|credential|\.pem|\.ya?ml|\.ini|\.tf"


def dictionary(docs: DataFrame, text: str = "text", most: int = WORDS) -> list[str]:
    """The words that stand in the most documents: all texts are counted, a bounded list of words comes back."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0)))
    n = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return [r.word for r in n.orderBy(F.desc("n"), "word").limit(most).collect()]


def features(value: Column, before: Column, after: Column, path: Column, words: list[str] | None = None) -> dict[str, Column]:
    """Numbers that the forest looks at, each a column expression; with a learned dictionary also how much of the value its words cover."""
    n = F.length(value).cast("double")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)).cast("double") / n
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    known = {}
    if words:
        pieces = F.filter(F.regexp_extract_all(value, F.lit(PIECE), F.lit(0)), lambda p: F.lower(p).isin(words))
        known = {"words": F.length(F.array_join(pieces, "")).cast("double") / n}
    uncovered = F.length(F.regexp_replace(F.lower(value), "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=len, reverse=True)), ""))
    return {
        "length": n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "signs": share("[^A-Za-z0-9]"),
        "hex": flag(value.rlike("^[0-9a-fA-F]+$")),
        "all_digits": flag(value.rlike("^[0-9]+$")),
        "kinds": share("(?<=[a-z])(?![a-z])|(?<=[A-Z])(?![A-Z])|(?<=[0-9])(?![0-9])"),
        "pairs": share("(?i)(?=" + "|".join(PAIRS) + ")"),
        "vowels": share("[aeiouAEIOU]"),
        "repeats": share(r"(?=(.)\1)"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))).cast("double") / n,
        "covered": 1 - uncovered / n,
        **known,
        "known_form": flag(value.rlike(r"^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|sk_live_|sk-|xox[abprs]-|AIza|eyJ|-----BEGIN )")),
        "secret_word": flag(F.right(before, F.lit(NEAR)).rlike(SECRET_WORDS)),
        "harmless_word": flag(F.right(before, F.lit(NEAR)).rlike(HARMLESS_WORDS)),
        "assigned": flag(before.rlike(r"""[=:]\s*["']?$""")),
        "userinfo": flag(before.rlike(r"(?i)(://[^\s/@:]*|\b(user|root|admin|\w*login)):$") & after.rlike("^@")),
        "quoted": flag(before.rlike("""["']$""") & after.rlike("""^["']""")),
        "test_path": flag(path.rlike(TEST_PATHS)),
        "config_path": flag(path.rlike(CONFIG_PATHS)),
    }


def labelled_findings(spark: SparkSession, n: int = LABELLED, words: list[str] | None = None) -> DataFrame:
    """Findings (value, before, after, path, label) made from a rule: half are secrets, half look like some.

    Every value follows from its number by a digest, so the table is the same each time. With a dictionary
    two thirds of the values that have words in them are made of its words, the others of syllables.
    """
    d = spotting.once(spark.range(0, n, 1, 1), F.col("id"), F.sha2(F.concat(F.lit("finding-"), F.col("id").cast("string")), 512).alias("h"))
    own = lambda i: F.pmod(F.xxhash64("h", F.lit("word"), i), F.lit(len(words))).cast("int") + 1
    mine = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.element_at(F.array(*map(F.lit, words)), own(i))) if words else F.array().cast("array<string>")
    d = spotting.once(d, F.col("id"), F.col("h"), mine.alias("mine"))
    h, pick = F.col("h"), lambda k, *options: F.element_at(F.array(*(F.lit(o) for o in options)), F.pmod(F.xxhash64("h", F.lit(k)), F.lit(len(options))).cast("int") + 1)
    b64 = F.translate(F.base64(F.unhex(h)), "\r\n", "")
    worded = (F.size("mine") > 0) & (F.pmod(F.xxhash64("h", F.lit("worded")), F.lit(3)) > 0)
    syllabic = lambda k, size: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: pick_at(k, i)), "")
    some = lambda k, size: F.when(worded, F.array_join(F.slice("mine", k % 13 + 1, (size + 1) // 3 or 1), "")).otherwise(syllabic(k, size))
    syllables = "th er an ti en lich keit ung tion ment eau re ci ado mente os che be in st ou".split()

    def pick_at(k: int, i: Column) -> Column:
        return F.element_at(F.array(*(F.lit(s) for s in syllables)), F.pmod(F.xxhash64("h", F.lit(k), i), F.lit(len(syllables))).cast("int") + 1)

    size = lambda k, *sizes: pick(k, *sizes)
    digits = lambda k, size: F.lpad(F.pmod(F.xxhash64("h", F.lit(k)), F.lit(10**size)).cast("string"), size, "0")
    secrets = [
        F.substring(h, 1, 32), F.substring(h, 1, 40), F.substring(h, 9, 64), F.upper(F.substring(h, 3, 40)), F.substr(b64, F.lit(1), size(1, 24, 32, 40, 44)),
        F.concat(F.lit("AKIA"), F.upper(F.substring(F.translate(b64, "+/=abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234"), 1, 16))), F.concat(F.lit("ghp_"), F.substring(F.translate(b64, "+/=", "aZ0"), 1, 36)),
        F.concat(F.lit("sk_live_"), F.substring(F.translate(b64, "+/=", "aZ0"), 5, 24)), F.concat(some(7, 2), F.substring(h, 1, 4), F.lit("!"), F.upper(some(8, 1))),
        F.concat(F.initcap(some(7, 2)), digits(51, 2), some(8, 2), digits(52, 1)), F.concat(F.initcap(some(7, 1)), digits(51, 1), some(8, 2), pick(53, "", "!", "@", "$", ".", "#"), some(12, 1), digits(52, 3)),
        F.concat(F.lit("-----BEGIN "), pick(70, "RSA ", "EC ", "OPENSSH ", ""), F.lit("PRIVATE KEY-----\n"), F.repeat(F.concat(b64, F.lit("\n")), pick(71, 2, 9, 18)), F.lit("-----END "), pick(70, "RSA ", "EC ", "OPENSSH ", ""), F.lit("PRIVATE KEY-----")),
        F.concat(F.lit("eyJ"), F.translate(F.substring(b64, 1, 20), "+/=", "-_A"), F.lit("."), F.translate(F.substring(b64, 21, 40), "+/=", "-_A"), pick(59, "", ".sig-", "._x"), F.translate(F.substring(b64, 60, 24), "+/=", "-_A")),
    ]
    harmless = [
        some(1, 5), some(2, 7), F.concat(some(3, 2), F.lit("_"), some(4, 2), F.lit("_"), some(5, 3)), F.concat(some(3, 2), F.initcap(some(4, 2)), F.initcap(some(5, 2))), F.concat(F.lit("/usr/"), some(6, 2), F.lit("/"), some(7, 3)),
        F.rpad(F.lit(""), 24, "x"), F.rpad(F.lit(""), 20, "0"), F.concat(some(3, 3), F.lit("-"), some(4, 3), F.lit("-"), some(5, 2)), F.lpad(F.translate(F.substring(h, 1, 16), "abcdef", "012345"), 16, "7"),
        F.upper(some(1, 6)), F.substring(h, 1, 40), F.substring(h, 1, 32), F.regexp_replace(F.substring(h, 1, 32), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"),
    ]
    # What stands after names and ":" or "=" in prose, code and addresses, and such names themselves.
    key_name = F.concat(F.upper(F.concat(some(14, 2), F.lit("_"), some(15, 2))), pick(58, "_TOKEN=", "_ACCESS_TOKEN=", "_SECRET_KEY=", "_SECRET=", "_KEY=", "_VALUE=", "_NAME="))
    ordinary = [
        key_name, key_name, key_name, F.lower(key_name),
        some(1, 4), F.initcap(some(2, 4)), F.concat(some(3, 2), F.lit("_"), some(4, 2)), F.concat(some(3, 2), F.lit("."), some(4, 2), F.lit("("), some(5, 1)), F.concat(some(1, 3), F.lit("@"), some(2, 2), F.lit(".org")),
        F.concat(F.lit("20"), digits(54, 2), F.lit("-0"), digits(55, 1), F.lit("-1"), digits(56, 1)), F.concat(digits(54, 3), F.lit("."), digits(55, 3), F.lit(".1"), digits(56, 2)), F.concat(F.lit("/"), some(6, 2), F.lit("/"), some(7, 2)), digits(57, 9),
        F.concat(some(3, 2), F.lit("-"), some(4, 3)), F.concat(some(3, 2), F.lit("/"), some(4, 3)), F.concat(F.initcap(some(3, 2)), F.initcap(some(4, 2))),
    ]
    choose = lambda k, options: F.element_at(F.array(*options), F.pmod(F.xxhash64("h", F.lit(k)), F.lit(len(options))).cast("int") + 1)
    secret = F.col("id") % 2 == 0
    kind = F.pmod(F.xxhash64("h", F.lit(22)), F.lit(len(harmless)))
    words = F.concat(some(9, 3), F.lit(" "), some(10, 2), F.lit(" "))
    # Half of the passwords stand in addresses. A secret that tells itself by its form may stand without a telling word, a name or a word may stand after one.
    telling = pick(31, 'token = "', "password: ", 'api_key="', "SECRET=", "Authorization: Bearer ", "access_key = '", 'TOKEN = "', "auth ", "AWS_SECRET_ACCESS_KEY=", '"client_secret": "', "GITHUB_TOKEN=", '"private_key_value": "', "password is ", "the token is ")
    plain, form = pick(35, 'value = "', "X_VALUE=", "use ", '"id": "', " ", "("), F.pmod(F.xxhash64("h", F.lit(21)), F.lit(len(secrets)))
    seldom = lambda k: F.pmod(F.xxhash64("h", F.lit(k)), F.lit(4)) == 0
    named, address = ~secret & seldom(61), secret & form.between(8, 10) & (F.pmod(F.xxhash64("h", F.lit(62)), F.lit(2)) == 0)
    contact = named & seldom(63)
    near = F.when(address, pick(64, "postgres://user:", "https://admin:", "root:", "user:", "mysql://app:")).when(contact, pick(65, "mailto:", "contact:", "mail:", "write to:")).when(
        named, pick(66, "note: ", "name: ", "type=", "see also: ", "path = ", "date: ", "n = ", "self.value = ", "return: ", "password: ", "password is ", "the key was ", "token = ", "secret: ", "id=", "export ", "export ", "\n", " ")
    ).when(secret & (form.between(4, 7) | (form >= 11)) & seldom(36), plain).when(secret, telling).when(
        kind >= 10, pick(32, "commit ", "sha256: ", "checksum ", "md5 ", "version ", "uuid: ", 'etag="', "revision ")
    ).when(seldom(37), pick(38, "password: ", "SECRET=", 'token = "', '"client_secret": "', "auth ", "API_KEY=x ", "secret in ")).otherwise(pick(33, " ", " ", ". ", "| ", '"', "see ", "file ", "("))
    value = F.when(secret, choose(21, secrets)).when(contact, F.concat(some(1, 2), pick(68, "", ".", "_"), some(2, 2))).when(named, choose(69, ordinary)).otherwise(choose(22, harmless))
    d = spotting.once(d, F.col("id"), F.col("h"), F.col("mine"), value.alias("value"), near.alias("near"), (address | contact).alias("mailed"))
    near = F.col("near")
    after = F.when(F.col("mailed"), F.concat(F.lit("@"), some(13, 2), pick(67, "/db ", ".org ", ":80/ "))).when(near.rlike("\"$"), F.lit('" ')).when(near.rlike("'$"), F.lit("' ")).otherwise(pick(34, " ", ", ", ". ", "\n"))
    return spotting.once(
        d, F.col("value"), F.concat(words, near).alias("before"), F.concat(after, some(11, 2)).alias("after"),
        F.when(secret, pick(41, "app/.env", "deploy/config.yaml", "src/main.py", "src1", None)).otherwise(pick(42, "src/main.py", "tests/test_app.py", "docs/readme.md", "src1", None)).cast("string").alias("path"), secret.cast("double").alias("label"),
    )


def fitted(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED, words: list[str] | None = None):
    """Spark ML's forest over the features of labelled findings (value, before, after, path, label), and the features' names."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    made = features(F.col("value"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")), F.coalesce("path", F.lit("")), words)
    d = labelled.where("value IS NOT NULL AND label IS NOT NULL").select(*(c.alias(k) for k, c in made.items()), F.col("label").cast("double").alias("label"))
    d = VectorAssembler(inputCols=list(made), outputCol="features").transform(d).select("features", "label").coalesce(1)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(d)
    if model.numClasses != 2:
        raise ValueError("labelled findings need both classes")
    return model, list(made)


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED, words: list[str] | None = None) -> list:
    """Trees as nested lists: [feature, threshold, left, right] or the share of secrets in a leaf. A scan with them wants the same dictionary."""
    return read(*fitted(labelled, trees, depth, seed, words))


def learned(docs: DataFrame, text: str = "text") -> dict:
    """A corpus' own dictionary and a forest that was trained with it, as ``findings`` and ``redacted`` take them."""
    words = dictionary(docs, text)
    return {"forest": train(labelled_findings(docs.sparkSession, words=words), words=words), "words": words}


def read(model, names: list[str]) -> list:
    """The trees of a forest of Spark ML."""

    def node_of(node) -> list | float:
        if node.getClass().getSimpleName() == "LeafNode":
            a, b = list(node.impurityStats().stats())
            return round(b / (a + b), 6)
        s = node.split()
        return [names[s.featureIndex()], s.threshold(), node_of(node.leftChild()), node_of(node.rightChild())]

    return [node_of(t._java_obj.rootNode()) for t in model.trees]


def probability(forest: list, of: Column) -> Column:
    """The forest's mean share of secrets as one expression over a struct of features."""

    def tree(t: list | float) -> Column:
        return F.lit(t) if isinstance(t, float) else F.when(of[t[0]] <= t[1], tree(t[2])).otherwise(tree(t[3]))

    total = tree(forest[0])
    for t in forest[1:]:
        total = total + tree(t)
    return total / len(forest)


def judged(docs: DataFrame, forest: list, text: str = "text", path: str | None = "source", words: list[str] | None = None) -> DataFrame:
    """Each row as one struct, with gaps, hits and found: of every candidate its value, number and probability."""
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    d = spotting.once(docs, row, spotting.gaps(F.col(text), CANDIDATE).alias("gaps"), spotting.hits(F.col(text), CANDIDATE).alias("hits"), where.alias("where"))

    # A candidate has LEAST characters, so BEFORE // LEAST pieces of a gap and a candidate reach back as far as is looked.
    tails = F.zip_with("gaps", "hits", lambda g, h: F.right(F.concat(g, F.coalesce(h, F.lit(""))), F.lit(BEFORE)))
    heads = F.zip_with("hits", F.slice("gaps", F.lit(2), F.size("hits") + 1), lambda h, g: F.left(F.concat(h, g), F.lit(AFTER)))
    d = spotting.once(d, F.col("row"), F.col("gaps"), F.col("hits"), F.col("where"), tails.alias("tails"), heads.alias("heads"))

    def around(h: Column, i: Column) -> Column:
        reach = F.least(i, F.lit(BEFORE // LEAST))
        before = F.right(F.concat(F.array_join(F.slice("tails", i - reach + 1, reach), ""), F.right(F.get("gaps", i), F.lit(BEFORE))), F.lit(BEFORE))
        after = F.left(F.concat(F.left(F.get("gaps", i + 1), F.lit(AFTER)), F.array_join(F.slice("heads", i + 2, F.lit(AFTER // LEAST)), "")), F.lit(AFTER))
        return F.struct(h.alias("value"), i.alias("i"), before.alias("before"), after.alias("after"))

    def looked_at(s: Column) -> Column:
        return F.struct(s["value"].alias("value"), s["i"].alias("i"), *(c.alias(k) for k, c in features(s["value"], s["before"], s["after"], F.col("where"), words).items()))

    d = spotting.once(d, F.col("row"), F.col("gaps"), F.col("hits"), F.col("where"), F.transform("hits", around).alias("around"))
    looks = F.transform("around", looked_at)
    found = F.transform(looks, lambda s: F.struct(s["value"].alias("value"), s["i"].alias("i"), probability(forest, s).alias("p")))
    return spotting.once(d, F.col("row"), F.col("gaps"), F.col("hits"), found.alias("found"))


def kind(value: Column) -> Column:
    out = F.lit("other")
    for name, form in {"base64": r"^[A-Za-z0-9+/_\-]{20,}={0,2}$", "hex": "^[0-9a-fA-F]{16,}$", "jwt": "^eyJ", "google": "^AIza", "slack": "^xox", "stripe": "^sk_live_", "github": "^gh[pos]_|^github_pat_", "aws": "^A[KS]IA[0-9A-Z]{12,}$", "pem": "^-----BEGIN "}.items():
        out = F.when(value.rlike(form), F.lit(name)).otherwise(out)
    return out


def findings(docs: DataFrame, forest: list, key: str = "doc_id", text: str = "text", path: str | None = "source", least: float = 0.5, words: list[str] | None = None) -> DataFrame:
    """One row per secret: key, start, n_chars, kind, value_sha256 and probability. The secret itself isn't returned."""
    d = judged(docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *([F.col(path).alias("path")] if path else [])), forest, "text", "path" if path else None, words)
    sure = lambda s: s["p"] >= least
    d = spotting.once(d.where(F.exists("found", sure)), F.col("row.key").alias("key"), spotting.starts(F.col("gaps"), F.col("hits")).alias("starts"), F.filter("found", sure).alias("found"))
    d = d.select("key", "starts", F.explode("found").alias("s"))
    value = F.col("s.value")
    return d.select(
        F.col("key").alias(key), F.get("starts", F.col("s.i")).cast("long").alias("start"), F.length(value).cast("long").alias("n_chars"),
        kind(value).alias("kind"), F.sha2(value, 256).alias("value_sha256"), F.round("s.p", 6).alias("probability"),
    )


def redacted(docs: DataFrame, forest: list, text: str = "text", path: str | None = "source", least: float = 0.5, mark: str = "[secret]", words: list[str] | None = None) -> DataFrame:
    """The same rows and columns with each secret replaced; texts without secrets are as they were."""
    d = judged(docs, forest, text, path, words)
    sure = F.exists("found", lambda s: s["p"] >= least)
    clean = spotting.woven(F.col("gaps"), F.transform("found", lambda s: F.when(s["p"] >= least, F.lit(mark)).otherwise(s["value"])))
    new = F.when(sure, clean).otherwise(F.col(f"row.`{text}`"))
    return d.select(*(new.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
