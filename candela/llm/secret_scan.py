"""Secret scan: candidates from the texts, and a random forest that removes false positives. DataFrame and Spark ML functions only.

The forest sees a candidate's length, its character transitions, how much of it dictionary words cover, the path it is in
and its neighbouring words. It learns from labelled findings.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.common import packed, table

#: Runs that can be secrets: long ones anywhere, and shorter ones that are assigned to something, in one word or over white space.
LONG, ASSIGNED = "[A-Za-z0-9+/_\\-]{16,}={0,2}", "[:=][\"']?([A-Za-z0-9+/_\\-!@#$%^&*.]{8,})"
VALUE = "^[\"']?([A-Za-z0-9+/_\\-!@#$%^&*.]{8,})"
PLACES = "array<struct<place:int,found:string>>"
#: A block of base64 between its BEGIN and END lines, line breaks written out or not.
ARMOUR = "-----BEGIN [A-Z0-9 ]+-----[A-Za-z0-9+/=:,.\\\\<>_\\-\\s]*?-----END [A-Z0-9 ]+-----"
#: Elements that _running() sums at a time.
BLOCK = 64
SPACE = "[\\x20\\x09-\\x0D]+"
#: Words of the dictionary whose share in a candidate counts.
DICTIONARY = (
    "about above account action admin after again also always another answer any application article back because before between build button case change check class click close code color common config connect content control core create "
    "current custom data database date default delete demo detail device display document does domain down download each edit element email enable end error event every example export false feature field file filter find first folder "
    "follow font form format found free from full function general get global group hash have head header height hello help hidden home host html image import index info input insert install into item javascript keep label language "
    "large last layout left length level library light like line link list load local login long main make manager many menu message method mobile model module more most name national new next node none number object offset open option "
    "order other output over package page panel param parent part pass password path people place player plugin point position post print private process product profile project public query random read release remove report request "
    "require reset resource response result return right row sample save script search secret section select send server service session set show simple site size small sort source standard start state static status stop string style "
    "submit success support system table tag target task template test text that theme there this time title today token tool top total true type under update upload user using value version video view visible way website when which "
    "width will window with word work world write year your"
).split()
SECRET_WORDS = "password|passwd|pwd|secret|token|api|apikey|key|auth|credential|bearer|private|access"
HARMLESS_WORDS = "commit|sha|sha1|sha256|md5|hash|digest|checksum|revision|rev|uuid|guid|id|isbn|build|version|card|visa|iban|phone|order|invoice|etag|integrity"
TEST_PATHS = "test|example|sample|mock|fixture|demo|doc"
TREES, DEPTH, SEED = 40, 8, 11
#: Labelled findings that synthetic_findings() makes.
FINDINGS = 6000

FEATURES = ["length", "digits", "upper", "lower", "marks", "hexadecimal", "transitions", "letter_transitions", "distinct", "longest_digits", "dictionary", "in_test", "key_before", "assigned", "quoted", "harmless_before", "harmless_after", "block", "private"]


def _let(x: Column, use) -> Column:
    """use(x), with x computed once."""
    return F.element_at(F.transform(F.array(x), use), 1)


def _running(sizes: Column) -> Column:
    """For each element the sum of those before it. Sums of blocks come first, so the work is linear but for a part in BLOCK squared."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: acc + x)
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    place = lambda a, starts, i: F.get(starts, (i / BLOCK).cast("int")) + total(F.slice(a, (i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))
    blocks = lambda a: F.transform(upto(F.ceil(F.size(a) / BLOCK).cast("int")), lambda j: total(F.slice(a, j * BLOCK + 1, F.lit(BLOCK))))
    starts = lambda sums: F.transform(upto(F.size(sums)), lambda j: total(F.slice(sums, F.lit(1), j)))
    found = _let(sizes, lambda a: _let(starts(blocks(a)), lambda st: F.transform(upto(F.size(a)), lambda i: place(a, st, i))))
    return F.when(F.size(sizes) > 0, found).otherwise(F.array().cast("array<int>"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """id, start (0-based, in characters), candidate, word (where it stands), before, before2, after, path.

    A value that is assigned is a candidate as a whole, beside the long runs in it; whether letters alone are a secret is left
    to the forest. Words are parted by white space of any length; a value may follow its [:=] over white space. A block
    between BEGIN and END lines, such as a private key over many lines, is a candidate too. A null text has no candidates, a
    null path is empty. Every row and the whole text is searched, very long ones too, and each place of a candidate gives a
    row; repeated rows repeat their candidates; a text without candidates gives no row, an empty table none. Further columns
    are left out.
    """
    rows = packed(docs, id_col, text_col)
    path = F.coalesce(F.col("rest").getField(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    spot = f"({LONG})|({ASSIGNED})"
    blocks = F.when(F.contains("text", F.lit("-----BEGIN ")), _places(F.col("text"), f"({ARMOUR})"))
    rows = rows.select("id", "text", path.alias("path")).filter(F.col("text").rlike(f"({LONG})|[:=]({SPACE})?{VALUE[1:]}|-----BEGIN "))
    spaced = rows.select("id", "path", F.split("text", SPACE).alias("words"), F.regexp_extract_all("text", F.lit(SPACE), F.lit(0)).alias("gaps"), blocks.alias("blocks"))
    word = lambda i: F.coalesce(F.when(i >= 0, F.get("words", i)), F.lit(""))
    after_sign = lambda i: word(i - 1).rlike("[:=]$") & word(i).rlike(VALUE)
    sizes = F.transform("words", lambda w, i: F.char_length(w) + F.coalesce(F.char_length(F.get("gaps", i)), F.lit(0)))
    hits = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: word(i).rlike(spot) | after_sign(i))
    none = F.lit("")
    around = lambda at, i: F.struct(F.get(at, i).alias("offset"), *(word(i + j).alias(c) for j, c in ((0, "word"), (-1, "before"), (-2, "before2"), (1, "after"))), F.lit(None).cast("string").alias("block"))
    # a block's first line stands for its word, so that its kind is seen
    whole = lambda x: F.struct(x["place"].alias("offset"), F.regexp_extract(x["found"], "^-+BEGIN[^-]*-+", 0).alias("word"), *(none.alias(c) for c in ("before", "before2", "after")), x["found"].alias("block"))
    # places are added up only where there is a hit
    placed = _let(hits, lambda found: F.when(F.size(found) > 0, _let(_running(sizes), lambda at: F.transform(found, lambda i: around(at, i)))))
    nothing = F.array().cast("array<struct<offset:int,word:string,before:string,before2:string,after:string,block:string>>")
    placed = F.concat(F.coalesce(placed, nothing), F.coalesce(F.transform("blocks", whole), nothing))
    # exploded as an expression: of a column, Spark would infer a filter that is pushed below and splits the text for each word
    found = spaced.select("id", "path", F.explode(placed).alias("hit")).select("id", "path", "hit.*")
    at_first = F.when(F.col("before").rlike("[:=]$"), _places(F.col("word"), VALUE)).otherwise(F.array().cast(PLACES))
    # the three patterns never find one value at one place: short ones are not wholly long, and VALUE's have no sign before them
    short = F.filter(F.concat(_places(F.col("word"), ASSIGNED), at_first), lambda x: ~x["found"].rlike(f"^({LONG})$"))
    inside = F.concat(_places(F.col("word"), f"({LONG})"), short)
    every = found.withColumn("one", F.explode(F.when(F.col("block").isNotNull(), F.array(F.struct(F.lit(0).alias("place"), F.col("block").alias("found")))).otherwise(inside)))
    return every.select("id", (F.col("offset") + F.col("one.place")).cast("long").alias("start"), F.col("one.found").alias("candidate"), "word", "before", "before2", "after", "path")


def _places(word: Column, pattern: str) -> Column:
    """place (0-based) and found, the pattern's group 1, of each match; the group must end where the match does."""
    matches, groups = F.regexp_extract_all(word, F.lit(pattern), F.lit(0)), F.regexp_extract_all(word, F.lit(pattern), F.lit(1))
    each = lambda found: _let(F.split(word, pattern), lambda gaps: F.transform(found, lambda m, i: F.char_length(F.get(gaps, i)) + F.char_length(m)))
    struct = lambda at, sizes, own: F.transform(own, lambda g, i: F.struct((F.get(at, i) + F.get(sizes, i) - F.char_length(g)).alias("place"), g.alias("found")))
    return _let(each(matches), lambda sizes: _let(_running(sizes), lambda at: struct(at, sizes, groups)))


def featured(found: DataFrame) -> DataFrame:
    c, n = F.col("candidate"), F.char_length("candidate").cast("double")
    share = lambda of: (F.regexp_count(c, F.lit(of)) / n).cast("double")
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
    sounds = F.regexp_replace(F.regexp_replace(F.lower(c), "[aeiouy]+", "1"), "[a-z]+", "2")
    longest = F.array_max(F.transform(F.regexp_extract_all(c, F.lit("([0-9]+)"), F.lit(1)), lambda x: F.char_length(x)))
    rest = F.char_length(F.regexp_replace(F.lower(c), "|".join(sorted(DICTIONARY, key=len, reverse=True)), ""))
    flag = lambda x: x.cast("double")
    near = F.concat_ws(" ", F.lower("before2"), F.lower("before"), F.lower("word"))
    return found.withColumns({
        "length": n, "digits": share("[0-9]"), "upper": share("[A-Z]"), "lower": share("[a-z]"), "marks": share("[^A-Za-z0-9]"),
        "hexadecimal": flag(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")), "transitions": (F.char_length(runs) - 1) / n, "letter_transitions": (F.char_length(sounds) - 1) / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n, "longest_digits": F.coalesce(longest, F.lit(0)) / n, "dictionary": 1 - rest / n,
        "in_test": flag(F.lower("path").rlike(TEST_PATHS)), "key_before": flag(near.rlike(f"(^|[^a-z])({SECRET_WORDS})[\"']?\\s*[:=]?")), "assigned": flag(near.rlike("[:=]")),
        "quoted": flag(F.col("word").rlike("[\"']")), "harmless_before": flag(F.concat_ws(" ", F.lower("before2"), F.lower("before")).rlike(f"(^|[^a-z])({HARMLESS_WORDS})([^a-z]|$)")),
        "block": flag(c.startswith("-----BEGIN ")), "private": flag(F.col("word").rlike("PRIVATE|SECRET")),
        "harmless_after": flag(F.lower("after").rlike(f"^({HARMLESS_WORDS})")),
    })


def synthetic_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """n labelled findings (the columns of candidates(), and label): secrets of many forms, and what is taken for them.

    The test tables hold no labelled findings, so these are made by rule, from hashes of row numbers. Pass your own labelled
    table to train() where there is one.
    """
    i = F.col("i")
    hexes = lambda salt, k: F.substring(F.sha2(F.concat(F.lit(salt), i.cast("string")).cast("binary"), 256), 1, k)
    mixed = lambda salt, k: F.substring(F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit(salt), i.cast("string")).cast("binary"), 512))), "[+/=]", "x"), 1, k)
    digits = lambda salt, k: F.lpad(F.substring(F.regexp_replace(hexes(salt, 64), "[a-f]", ""), 1, k), k, "7")
    pick = lambda salt, *xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64(F.lit(salt), i), F.lit(len(xs))) + 1).cast("int"))
    word = lambda salt: pick(salt, "the", "of", "and", "value", "see", "about", "la", "der", "que", "in", "with", "new", "", "are.")
    name = lambda salt: pick(salt, "password", "token", "secret", "api_key", "auth_token", "access_key", "client_secret", "PASSWORD", "TOKEN")
    alpha = lambda salt, k: F.translate(mixed(salt, k), "0123456789", "kQzWmJvBpH")
    syllable = lambda salt: pick(salt, "ver", "ka", "tion", "lo", "schaft", "men", "ri", "sta", "ge", "nal", "bu", "ent", "po", "lich", "do", "ra")
    natural = lambda salt, k: F.concat(*(syllable(f"{salt}{j}") for j in range(k)))
    plain = lambda salt: pick(salt, *DICTIONARY)
    letters = lambda salt, k: F.translate(hexes(salt, k), "0123456789", "theronisad")
    armour = lambda form, kind, body: F.concat(F.lit("-----BEGIN "), form, kind, F.lit("-----\n"), body, F.lit("\n-----END "), form, kind, F.lit("-----"))
    # kind -> label, candidate, word in which it stands ({} is the candidate), two words before, word after
    eq = F.concat(name("n"), F.lit("={}"))
    quote = F.lit('"{}"')
    kinds = [
        (1, hexes("a", 18), eq, word("p"), word("q"), word("r")),
        (1, F.concat(hexes("b", 40)), quote, name("n"), pick("e", "=", ":"), word("r")),
        (1, F.concat(F.lit("AKIA"), F.upper(F.translate(mixed("c", 16), "xyz", "ABC"))), F.lit("{}"), word("p"), word("q"), word("r")),
        (1, mixed("d", 40), quote, name("n"), pick("e", "=", ":"), word("r")),
        (1, mixed("f", 20), eq, word("p"), word("q"), word("r")),
        (1, F.concat(pick("t", "ghp_", "sk_live_", "xoxb-", "glpat-"), mixed("g", 32)), F.lit("{}"), word("p"), word("q"), word("r")),
        (1, F.upper(hexes("h", 40)), quote, name("n"), F.lit("="), word("r")),
        (0, digits("i", 16), F.lit("{}"), word("p"), word("q"), word("r")),
        (0, hexes("j", 40), F.lit("{}"), pick("k", "commit", "sha1", "revision", "hash"), pick("e", "is", ":", ""), word("r")),
        (0, F.concat_ws("-", hexes("k", 8), hexes("l", 4), hexes("m", 4), hexes("n", 12)), F.lit("{}"), pick("k", "uuid", "id", "guid", "request"), pick("e", "is", ":", "="), word("r")),
        (0, F.concat_ws("-", pick("u", "release", "project", "update"), pick("v", "notes", "version", "default"), F.lit("2024"), digits("o", 4)), F.lit("{}"), word("p"), word("q"), word("r")),
        (0, F.concat(F.lit("/"), letters("p", 6), F.lit("/"), letters("q", 9), F.lit("/index"), digits("r", 2)), F.lit("{}"), word("p"), word("q"), word("r")),
        (0, F.concat(pick("x", "your_token_here_", "example_password_", "changeme_secret_"), digits("s", 3)), eq, word("p"), word("q"), word("r")),
        (0, F.concat(letters("t", 14), digits("u", 4)), F.lit("{}"), word("p"), word("q"), word("r")),
        (0, digits("v", 20), F.concat(pick("k", "order", "invoice", "id"), F.lit("={}")), word("p"), word("q"), word("r")),
        # letters and marks only
        (1, F.substring(alpha("la", 20), 1, 16), eq, word("p"), word("q"), word("r")),
        (1, alpha("lb", 20), quote, name("n"), pick("e", "=", ":"), word("r")),
        (1, alpha("lc", 20), F.lit("{}"), word("p"), word("q"), word("r")),
        (1, F.concat(F.initcap(natural("ld", 2)), pick("le", "-", "!", "_", "."), F.initcap(natural("lf", 2)), pick("lg", "-", "!", "#", "$"), F.initcap(natural("lh", 3))), eq, word("p"), word("q"), word("r")),
        (1, F.concat(alpha("li", 4), pick("lj", "!", "@", "#", "%"), F.lower(alpha("lk", 12))), eq, word("p"), word("q"), word("r")),
        (0, natural("lm", 6), F.lit("{}"), word("p"), word("q"), word("r")),
        (0, F.initcap(natural("ln", 6)), F.lit("{}"), word("p"), word("q"), word("r")),
        (0, F.upper(natural("lo", 6)), F.lit("{}"), word("p"), word("q"), word("r")),
        (0, F.concat_ws("-", plain("lp"), natural("lq", 2), plain("lr"), natural("ls", 2)), F.lit("{}"), word("p"), word("q"), word("r")),
        (0, F.concat(plain("lt"), F.initcap(plain("lu")), F.initcap(plain("lv")), F.initcap(plain("lw"))), F.lit("{}"), word("p"), word("q"), word("r")),
        (0, F.concat(plain("lt"), F.initcap(plain("lu")), F.initcap(plain("lv")), F.initcap(plain("lw"))), eq, word("p"), word("q"), word("r")),
        (0, F.concat_ws("_", F.upper(plain("lx")), F.upper(plain("ly")), F.upper(plain("lz"))), eq, word("p"), word("q"), word("r")),
        (0, F.concat(F.lit("/"), natural("ma", 2), F.lit("/"), natural("mb", 3), F.lit("/"), plain("mc")), F.lit("{}"), word("p"), word("q"), word("r")),
        (0, F.concat(F.lit("//www."), natural("md", 3), pick("me", ".com/", ".org/", ".de/"), plain("mf")), F.lit("https:{}"), word("p"), word("q"), word("r")),
        (0, pick("mg", "changeme", "required", "your_password", "example-token", "undefined", "process.env.PASSWORD", "config.password", "settings.SECRET_KEY", "example.password", "password-input-field"), eq, word("p"), word("q"), word("r")),
        (0, natural("mh", 4), F.concat(pick("mi", "lang", "title", "name", "type", "see"), pick("mj", "={}", ":{}")), word("p"), word("q"), word("r")),
        # blocks of many lines
        (1, armour(pick("na", "RSA ", "", "EC ", "OPENSSH "), F.lit("PRIVATE KEY"), F.concat(mixed("nb", 64), F.lit("\n"), mixed("nc", 64), F.lit("\n"), mixed("nd", 40), F.lit("="))), pick("na", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "-----BEGIN EC PRIVATE KEY-----", "-----BEGIN OPENSSH PRIVATE KEY-----"), F.lit(""), F.lit(""), F.lit("")),
        (0, armour(F.lit(""), pick("ne", "CERTIFICATE", "PUBLIC KEY", "CERTIFICATE REQUEST"), F.concat(mixed("nf", 64), F.lit("\n"), mixed("ng", 64), F.lit("\n"), mixed("nh", 40), F.lit("="))), F.concat(F.lit("-----BEGIN "), pick("ne", "CERTIFICATE", "PUBLIC KEY", "CERTIFICATE REQUEST"), F.lit("-----")), F.lit(""), F.lit(""), F.lit("")),
        (0, armour(F.lit(""), F.lit("PRIVATE KEY"), pick("ni", "...", "<your-private-key-goes-here>", "example", "paste key here")), F.lit("-----BEGIN PRIVATE KEY-----"), F.lit(""), F.lit(""), F.lit("")),
        # short ones, with and without white space after the sign
        (1, F.concat(letters("sa", 6), digits("sb", 3)), F.lit("{}"), word("p"), F.concat(name("n"), pick("e", ":", "=")), word("r")),
        (1, F.substring(F.lower(mixed("sc", 20)), 1, 9), pick("sd", "{}", '"{}"', "'{}',"), name("n"), pick("e", "=", ":"), word("r")),
        (1, F.concat(letters("se", 6), digits("sf", 2), pick("sg", "x", "!", "#")), pick("sh", '"{}"', '"{}",'), word("p"), F.concat(F.lit('"'), name("n"), F.lit('":')), word("r")),
        (1, F.concat(natural("si", 2), F.substring(digits("sj", 6), 1, 4)), eq, word("p"), word("q"), word("r")),
        (0, natural("sk", 4), pick("sl", "{}", '"{}"', "{},", "{}."), word("p"), F.concat(pick("sm", "note", "title", "name", "type", "see", "lang"), pick("e", ":", "=")), word("r")),
        (0, F.concat(natural("sn", 2), digits("so", 3)), pick("sl", "{}", '"{}"'), word("p"), F.concat(pick("sp", "model", "file", "user", "name", "title"), pick("e", ":", "=")), word("r")),
        (0, F.concat_ws("-", F.concat(F.lit("20"), F.substring(digits("sx", 4), 1, 2)), F.substring(digits("sq", 4), 1, 2), F.substring(digits("sr", 4), 1, 2)), F.lit("{}"), word("p"), F.concat(pick("ss", "date", "from", "until"), pick("e", ":", "=")), word("r")),
        (0, digits("st", 9), F.lit("{}"), pick("su", "id", "order", "phone", "invoice"), pick("e", ":", "="), word("r")),
        (0, pick("sv", "changeme", "required", "your_password", "example-token", "undefined", "process.env.PASSWORD", "config.password", "settings.SECRET_KEY", "example.password"), pick("sd", "{}", '"{}"', "'{}',"), word("p"), F.concat(name("n"), pick("e", ":", "=")), word("r")),
    ]
    parts = F.array(*(F.struct(F.lit(label).alias("label"), c.alias("candidate"), w.alias("form"), b2.alias("before2"), b.alias("before"), a.alias("after")) for label, c, w, b2, b, a in kinds))
    rows = spark.range(n).withColumnRenamed("id", "i").withColumn("x", F.element_at(parts, (F.pmod(i, F.lit(len(kinds))) + 1).cast("int")))
    # either kind of path holds either label; tests hold more false positives
    chance = F.pmod(F.xxhash64(i, F.lit(5)), F.lit(100))
    in_test = chance < F.when(F.col("x.label") == 0, 15).otherwise(5)
    path = F.when(in_test, "tests/fixture.py").when(chance < 25, "src/config.py").otherwise(F.concat(F.lit("src"), F.pmod(i, F.lit(20)).cast("string")))
    return rows.select(i.alias("id"), F.lit(0).cast("long").alias("start"), "x.candidate", F.replace("x.form", F.lit("{}"), F.col("x.candidate")).alias("word"), "x.before", "x.before2", "x.after", path.alias("path"), F.col("x.label").cast("double").alias("label"))


def train(findings: DataFrame) -> PipelineModel:
    """findings: the columns of candidates() with label, 1.0 for secrets and 0.0 for false positives."""
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(featured(findings))


def secret_scan(docs: DataFrame, model: PipelineModel, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """The candidates that the model takes for secrets: id, start, candidate and score, the model's probability (see candidates())."""
    scored = model.transform(featured(candidates(docs, id_col, text_col, path_col))).withColumn("p", _second(F.col("probability")))
    return scored.filter(F.col("p") >= threshold).select("id", "start", "candidate", F.col("p").alias("score"))


def _second(vector: Column) -> Column:
    return F.element_at(vector_to_array(vector), 2)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings that stay, without the secrets themselves: where they are and a hash."""
    found = secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), train(synthetic_findings(spark)))
    return found.select(F.col("id").alias("doc_id"), "start", F.char_length("candidate").cast("long").alias("n_chars"), F.sha2(F.col("candidate").cast("binary"), 256).alias("secret_sha256"), F.round("score", 6).alias("score"))
