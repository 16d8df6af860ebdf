"""Secret scans with a random forest against false positives. DataFrame and ML functions of the JVM only.

A candidate is a run of at least MIN_LENGTH characters of a key's alphabet that holds a digit, a signed token of three parts
with dots between them, or, however short, without digits and with any signs, a value of 4 or more characters that an asking word
(ASKED) is given by = or : or `is`, that follows Bearer or Basic, or that stands as user:value@. Its
features: length; changes of character class and of letter, per character; the share of it that
dictionary words cover (of code and prose, in four languages like the asking words); whether it stands in a path or address; what the two words before and the
one after say. A random forest, trained from labelled findings, tells secrets from numbers, checksums,
identifiers and paths.

The labelled findings are a table, texts with one finding each and whether it is a secret: `findings`
(doc_id, text, secret) beside the documents. Where there is no such table they are made by rule (labelled_findings):
secrets in the shapes that configuration files, code, addresses and logs hold them in, against hashes,
identifiers, numbers, paths, placeholders and plain words in theirs.

Defined cases. Null and empty texts have no candidates and give no rows. A repeated row
gives its findings again. A candidate at either end of a text has empty neighbours. An empty table gives
an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvane.llm.common import read

MIN_LENGTH = 16
CANDIDATE = rf"eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+|[A-Za-z0-9+/_=\-]{{{MIN_LENGTH},}}"
SPACE = r"[\x20\x09-\x0D]+"
FEATURES = ["length", "digits", "turns", "shifts", "repeats", "hexadecimal", "covered", "pathlike", "asked", "assigned", "disclaimed", "followed", "symbols", "userinfo"]

#: Words of code and prose that are no part of a random key.
DICTIONARY = """
access account action add admin all allow also amount and api app archive area as assets auth back base buffer build
button by cache call card category change chapter check client code column commit company config connect content
control copy count country create data database date day debug default demo description details device disabled
display docs document domain download dummy each email enable end entry error event every example export false field
file for form format from function get handler hash have head header help here history home host html http image
import index info input insert instance internal invalid item java key label language layout level lib link list load
local log login main map message method missing model name network none note null number object off one only open
option optional order other output package page parent part pass path people photo place placeholder player plugin
point policy port post private process product profile project property public query read record redirect release
remote report request required resource response rest result review right root route rule sample save script search
secret section select server service session set
archivo cuenta datos entrada ejemplo fecha imagen inicio nombre pagina precio servicio usuario valor vacio
adresse compte courant donnees exemple fichier image mesure nom personne prix valeur utilisateur vide
anfang beispiel benutzer bild daten datei dienst eingabe fehler konto name nummer seite wert
""".split()
#: What asks for a secret, in English, Spanish, French and German; a word's end may follow.
ASKED = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|credential|auth|bearer|private|contrase[nñ]a|clave|ficha.de.acceso|mot.?de.?passe|passe\b|jeton|cl[eé]f?.d.?acc|kennwort|schl(?:ü|ue)ssel|geheim|zugangs)"
DISCLAIMED = r"(?i)(commit|checksum|sha|md5|digest|revision|example|sample|dummy|card|iban|order|invoice|uuid|id\b|etag|version)"


#: A value and its bounds; what asks for one in the same word, and in the two words before.
VALUE = r"""[^\s"'`,;<>(){}\[\]]{4,}"""
GIVEN = rf"""{ASKED}[\w.\-]*["'\]]*(?:=>|:=|=|:)["'`]*({VALUE})"""
USERINFO = r"""(?:^|[/"'(=])[^\s/:@"']*:([^\s/@"']{4,})@"""
BEFORE = rf"""{ASKED}[\w.\-]*["'\]]* ?(=>|:=|=|:|is|es|est|ist|lautet)$|(?i)(^|[\s"':=])(bearer|basic)$"""
#: Texts that may hold such a value.
MAYBE = rf"{ASKED}|(?i)basic|:[^\s/@]{{4,}}@"


def _values(within: Column, before: Column) -> Column:
    """Candidates of a word by what asks for them."""
    found = lambda p, n: F.regexp_extract_all(within, F.lit(p), F.lit(n))
    after = F.when(before.rlike(BEFORE), F.array(F.regexp_extract(within, VALUE, 0))).otherwise(F.array().cast("array<string>"))
    each = F.concat(found(GIVEN, 2), found(USERINFO, 1), after)
    return F.filter(F.transform(each, lambda v: F.regexp_replace(v, "[.:]+$", "")), lambda v: F.length(v) >= 4)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, word (its place among the words), nth in the word, and the candidate with its surroundings."""
    held = docs.select("doc_id", "text").where(F.col("text").rlike(CANDIDATE) | F.col("text").rlike(MAYBE))
    words = held.select("doc_id", F.split("text", SPACE).alias("w"))
    at = lambda i: F.coalesce(F.get(F.col("w"), i), F.lit(""))
    before = lambda i: F.concat_ws(" ", at(i - 2), at(i - 1))
    asked = lambda x, i: x.rlike(ASKED) | x.contains("@") | before(i).rlike(BEFORE)
    spots = words.select("doc_id", "w", F.explode(F.filter(F.transform("w", lambda x, i: F.when(x.rlike(CANDIDATE) | asked(x, i), i)), lambda i: i.isNotNull())).alias("word"))
    spots = spots.select("doc_id", "word", at(F.col("word") - 2).alias("before2"), at(F.col("word") - 1).alias("before1"), at(F.col("word")).alias("within"), at(F.col("word") + 1).alias("after1"))
    runs = F.filter(F.regexp_extract_all("within", F.lit(CANDIDATE), F.lit(0)), lambda c: c.rlike("[0-9]"))
    values = _values(F.col("within"), F.concat_ws(" ", "before2", "before1"))
    return spots.select("*", F.posexplode(F.concat(runs, F.array_except(values, runs))).alias("nth", "candidate"))


def features(found: DataFrame) -> DataFrame:
    c = F.col("candidate")
    n = F.length(c).cast("double")
    share = lambda p: F.regexp_count(c, F.lit(p)) / n
    flag = lambda x: x.cast("double")
    lead = F.expr("substring_index(within, candidate, 1)")
    words: Column = F.concat_ws(" ", "before2", "before1", lead)
    return found.withColumns({
        "length": n,
        "digits": share("[0-9]"),
        "turns": share("(?<=[a-z])(?=[0-9A-Z])|(?<=[A-Z])(?=[0-9a-z])|(?<=[0-9])(?=[A-Za-z])"),
        "shifts": share("[aeiouAEIOU](?=[^aeiouAEIOU])"),
        "repeats": share(r"(.)(?=\1)"),
        "hexadecimal": flag(c.rlike("^[0-9a-f]+$")),
        "covered": F.lit(1.0) - F.length(F.regexp_replace(F.lower(c), "|".join(DICTIONARY), "")) / n,
        "pathlike": flag(F.col("within").rlike(r"://|^[./~]|/[A-Za-z0-9_\-]+/|\.[a-z]{2,4}(\W|$)")),
        "asked": flag(words.rlike(ASKED)),
        "assigned": flag(F.concat_ws(" ", "before1", lead).rlike("[=:][\"'\\s]*$|^(=|:|:=|=>) ")),
        "disclaimed": flag(words.rlike(DISCLAIMED)),
        "followed": flag(F.col("after1").rlike("^[;,)}\"'#]")),
        "symbols": share("[^A-Za-z0-9]"),
        "userinfo": flag(F.col("within").contains(F.concat(c, F.lit("@")))),
    })


def _shapes() -> dict[str, tuple[int, Column]]:
    """name: secret or not, and a text with one finding, made from the number `id`."""
    i = F.col("id").cast("string")
    seen = lambda salt, n, cut: F.translate(F.base64(F.unhex(F.sha2(F.concat(F.lit(salt), i), 512))), "+/=", cut).substr(1, n)
    key = lambda n: seen("k", n, "xyz")  # noqa: E731  letters and digits
    letters = lambda n: F.translate(seen("l", n, "abc"), "0123456789", "QwZrTkPsXv")
    sha, md5 = F.sha1(i), F.md5(i)
    word = F.translate(F.md5(F.concat(F.lit("w"), i)).substr(1, 7), "0123456789", "ghijklmnop")
    digits = lambda n: F.translate(F.sha2(F.concat(F.lit("d"), i), 256), "abcdef", "314159").substr(1, n)
    pick = lambda words, step: F.element_at(F.array(*map(F.lit, words)), (F.floor(F.col("id") / step) % len(words) + 1).cast("int"))
    ask = pick(["token", "api_key", "secret", "password", "access_key", "auth_token", "client_secret", "passwd", "credential"], 1)
    name = pick(["server", "static", "example", "release", "config", "version", "content", "profile", "gallery"], 2)
    plain = pick(["required", "None", "optional", "string", "missing", "null", "invalid", "expired", "false", "never", "stored", "disabled"], 3)
    uuid = F.concat_ws("-", md5.substr(1, 8), md5.substr(9, 4), md5.substr(13, 4), md5.substr(17, 4), md5.substr(21, 12))
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    return {
        "environment": (1, text("export ", F.upper(ask), "=", key(40), "\n")),
        "json": (1, text('{"', ask, '": "', md5, '", "user": "', word, '"}')),
        "yaml": (1, text(ask, ": ", key(4), "!", letters(2), ".", digits(3), " # ", word)),
        "bearer": (1, text("Authorization: Bearer ", key(43), " ", word)),
        "address": (1, text(word, " postgres://admin:", key(10), "@db.example.org/main")),
        "provider key": (1, text("use ", pick(["ghp_", "sk_live_", "xoxb-", "AKIA"], 5), key(24), " for ", word)),
        "single quotes": (1, text(ask, " = '", letters(20), "';")),
        "spoken": (1, text("the ", ask, " is ", key(18), ". ", word)),
        "short": (1, text(word, " ", ask, "=", key(9), " ", word)),
        "spanish": (1, text("la ", pick(["contraseña", "clave", "clave_secreta"], 3), pick([" = ", ": ", " es "], 5), key(9), "!", letters(2), " ", word)),
        "french": (1, text(word, " ", pick(["mot de passe", "jeton", "mot-de-passe"], 3), pick([" : ", " = ", " est "], 5), letters(5), digits(3), "!")),
        "german": (1, text(pick(["Passwort", "Kennwort", "Schlüssel", "Geheimnis"], 3), pick([": ", "=", " lautet "], 5), key(12), "; ", word)),
        "signed token": (1, text(pick(["", "Authorization: Bearer ", "jwt="], 3), "eyJ", key(17), ".eyJ", letters(30), ".", seen("s", 43, "_-x"), " ", word)),
        "long hexadecimal": (1, text(word, " ", ask, " => ", F.sha2(i, 256), ",")),
        "commit": (0, text("commit ", sha, " ", word)),
        "checksum": (0, text("sha256 checksum: ", F.sha2(i, 256), " of ", word, ".zip")),
        "uuid": (0, text("request ", uuid, " from ", word)),
        "number": (0, text(word, " order ", digits(12), " and ", digits(18), " of ", word)),
        "page": (0, text("see https://www.example.org/", name, "/", word, "-", i, "/index.html")),
        "path": (0, text("in /usr/lib/", name, "/", word, "/", name, "-", digits(2), ".so now")),
        "element": (0, text('<div id="', name, "-main-", name, "-", digits(3), '">')),
        "stand-in": (0, text(ask, " = your_", name, "_here_", digits(1))),
        "crossed out": (0, text(ask, ": ", F.repeat(pick(["x", "*", "x1", "0"], 7), 16), " ", word)),
        "said value": (0, text(ask, ": ", plain, " ", word)),
        "given value": (0, text(ask, "=", plain, " ", word)),
        "explained": (0, text("the ", ask, " is ", plain, " here")),
        "said in other tongues": (0, text(pick(["contraseña: ", "mot de passe : ", "Passwort: ", "la clave es ", "das Kennwort lautet "], 2), pick(["olvidada", "oublié", "vergessen", "segura", "perdue", "falsch", "obligatoria", "requis", "nötig"], 3), " ", word)),
        "dotted name": (0, text("in ", name, ".", word, ".", name, "_", digits(2), ".handler now")),
        "code": (0, text(ask, " = ", name, ".", plain, "(", word, ")")),
        "image": (0, text("data:image/png;base64,", key(40), key(24), " ", word)),
        "etag": (0, text('ETag: "', md5, '" ', word)),
    }


#: Shapes whose texts are made by one expression; the code that is compiled for more gets too long.
TOGETHER = 6


def labelled_findings(spark: SparkSession, n: int = 4000, shapes: list[str] | None = None) -> DataFrame:
    """doc_id, text, secret: n small texts with a finding each, half of them secrets, made by rule from the numbers below n."""
    known = {k: v for k, v in _shapes().items() if shapes is None or k in shapes}
    secret, out = (F.col("id") % 2 == 0).cast("int"), None
    for kind in (0, 1):
        texts = [text for of, text in known.values() if of == kind]
        nth = F.floor(F.col("id") / 2) % max(len(texts), 1)
        for first in range(0, len(texts), TOGETHER):
            some = texts[first : first + TOGETHER]
            rows = spark.range(n).where((secret == kind) & (nth >= first) & (nth < first + len(some)))
            rows = rows.select(F.col("id").alias("doc_id"), F.get(F.array(*some), (nth - first).cast("int")).alias("text"), secret.alias("secret"))
            out = rows if out is None else out.unionByName(rows)
    return out


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of labelled findings, or those made by rule where there is none."""
    try:
        return read(spark, sf_dir, "findings").select("doc_id", "text", "secret")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return labelled_findings(spark)


def train(labelled: DataFrame, most: int = 20_000, trees: int = 20, depth: int = 8, seed: int = 7) -> PipelineModel:
    """The forest, from texts with one finding each: doc_id, text, secret; those `most` with the least hash of the id, if there are more."""
    some = labelled.where(F.col("secret").isin(0, 1) & F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "text").limit(most)
    found = features(candidates(some)).join(some.select("doc_id", F.col("secret").cast("double").alias("secret")), "doc_id")
    forest = RandomForestClassifier(featuresCol="vector", labelCol="secret", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="vector"), forest]).fit(found)


def scan(docs: DataFrame, model: PipelineModel | None = None) -> DataFrame:
    """Every candidate of docs: doc_id, word, nth, candidate, the features, score, is_secret."""
    model = model or train(labelled_findings(docs.sparkSession))
    scored = model.transform(features(candidates(docs)))
    score = F.round(vector_to_array("probability")[1], 6)
    return scored.select("doc_id", F.col("word").cast("long").alias("word"), F.col("nth").cast("long").alias("nth"), "candidate", *FEATURES, score.alias("score"), (score >= 0.5).alias("is_secret"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of the documents, its SHA-256 in place of the candidate, its score and verdict.

    Null and empty texts have none, repeated rows give theirs again, an empty table gives no rows.
    """
    out = scan(read(spark, sf_dir, "documents"), train(findings(spark, sf_dir)))
    return out.select("doc_id", "word", "nth", F.col("length").cast("int").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")
