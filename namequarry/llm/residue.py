"""Template residue, filler, error pages and script notices found by a linear classifier on segments of text."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from namequarry.session import work_dir, written

DIMENSIONS = 1 << 16
PRIOR = 8.0  # weight of all sound segments against all of each other class
HELD_OUT = 4  # one host in so many is kept for validation
SURE = 0.8  # probability at which an undecided segment is trained on
CERTAIN = 0.5  # the one threshold: of a segment's class, and of the share of a text's characters
SOUND, RESIDUE, MARKED = 0.0, 1.0, 2.0  # classes of segments

# Weak labels. They train the classifier and are used nowhere else.
_WORD = r"[A-Za-z][A-Za-z0-9]*"
_NAME = rf"{_WORD}(?:[._-]{_WORD})*"  # what stands between the marks of a template
_PLAIN = r"(?:price|seller|buyer|wallet|user|username|userName|name|title|date|amount)"  # single words that marks used in prose need
_JOINED = rf"(?:{_WORD}(?:[._-]{_WORD})+|{_PLAIN})"
#: Placeholders of the common template languages, and values that were never set.
PLACEHOLDER = "|".join((
    rf"\{{\{{\s*{_NAME}\s*\}}\}}", rf"[$#]\{{\s*{_NAME}\s*\}}", rf"\[\[\s*{_NAME}\s*\]\]", rf"<%=?\s*{_NAME}\s*%>", rf"\{{%\s*{_NAME}\s*%\}}",
    r"%[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*%", r"(?<![A-Za-z0-9_])__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__(?![A-Za-z0-9_])", rf"@@\s*{_NAME}\s*@@", r"<<[^<>\n]{1,40}>>",
    rf"«{_JOINED}»", rf"\${_JOINED}\$", rf"(?<![$#{{])\{{{_JOINED}\}}(?!\}})", r"\[[A-Z][A-Z0-9]*(?:[_ ][A-Z0-9]+)+\]", r"<[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+>",
    r"\[(?:USERNAME|PRICE|SELLER|BUYER|NAME|DATE|TITLE|WALLET|AMOUNT)\]", r"<(?:USERNAME|PRICE|SELLER|BUYER|NAME|DATE|WALLET|AMOUNT)>",
    r"[\[<(](?i:insert|enter|add|your|introduzca|inserte|вставьте|укажите|введите)\s[^\[\]<>()\n]{1,40}[\])>]", r"\[[^\[\]\n]{1,30}\s(?:einfügen|eingeben|eintragen)\]",
    r"\bTODO:\s", r"\[object Object\]", r"\bInvalid Date\b", r"\$?(?<![A-Za-z0-9_])undefined(?![A-Za-z0-9_])", r"(?<![A-Za-z0-9_])NaN(?![A-Za-z0-9_])",
))
#: What every placeholder holds one of; texts without any aren't searched.
_HINT = r"[{\[<%@«$(]|__|undefined|NaN|TODO|Invalid"
#: Response states: a number of the 4xx or 5xx range said as one.
STATUS = r"(?iu)^(?:http/?[\d.]* ?)?[45]\d\d\b\W{0,4}(?:error|not found|page not found|gone|forbidden|bad gateway|(?:service )?unavailable|internal|too many|unauthorized|gateway timeout)|\b(?:error|fehler|ошибка|status|(?:error )?code|код|código|http) [45]\d\d\b|\"(?:code|status)\": ?\"?[45]\d\d\b"
# fixed values: words of the usual filler passage
_LATIN = "(?:lorem|ipsum|dolor|sit|amet|consectetur|adipiscing|elit|sed|eiusmod|tempor|incididunt|labore|dolore|magna|aliqua|enim|minim|veniam|quis|nostrud|exercitation|ullamco|laboris|nisi|aliquip|commodo|consequat|duis|aute|irure|velit|esse|cillum|fugiat|nulla|pariatur|excepteur|sint|donec|urna|mauris)"
#: Common wordings of error pages, script notices and filler in the corpus' languages.
PHRASES = "(?iu)" + "|".join((
    r"(?:enable|activate|turn on|switch on|allow) (?:your |the )?(?:javascript|js\b|scripts?\b|client-side script)|javascript (?:is|must be) (?:disabled|off|required|enabled|turned)|requires? (?:javascript|js\b|client-side script)|without (?:javascript|scripts)|script (?:execution|support)|needs? (?:javascript|js\b|scripts?\b|client-side script)|checking your browser|verify (?:that )?you are",
    r"(?:page (?:was |could )?not (?:be )?|nothing (?:was )?)found|access denied|permission denied|not allowed to (?:view|open|access)|(?:internal |the )?server (?:error|failed)|something went wrong|(?:unexpected|internal) error|error (?:has )?occurred|there was a problem with|could not (?:be )?(?:load|complete)|temporarily unavailable|down for maintenance|gateway time-?out|bad gateway|too many requests|this site can.t be reached|traceback \(most recent|(?:type|reference|syntax|value|key)error:|(?:connection|session) (?:was |has )?(?:expired|timed out|dropped|reset)",
    rf"(?:\b{_LATIN}\b[ ,.]*){{3}}|sample text|(?:dummy|placeholder) (?:text|copy|paragraph)|(?:text|description|title|headline|caption) goes here|your (?:headline|title|text) here|coming soon|to be written|body (?:copy|text)|button (?:label|text)|sub-?(?:title|headline)|asdf|(?:\btest\s+){{2}}test\b|x{{3,}} x{{2,}}",
    r"(?:aktivieren|erlauben|schalten) sie (?:bitte )?(?:javascript|skripte|js\b)|javascript (?:aktivieren|einschalten|erlauben)|seite (?:wurde |konnte )?nicht (?:gefunden|geladen)|zugriff verweigert|fehler ist aufgetreten|serverfehler|wegen eines fehlers|(?:leider|zurzeit) (?:ist|nicht)|nicht erreichbar|später (?:noch einmal|erneut)|beispieltext|platzhalter|blindtext|hier steht (?:später|bald)|kommt noch",
    r"(?:active|habilite|permita) (?:los |el )?(?:javascript|js\b|scripts)|(?:necesita|requiere) (?:javascript|js\b)|página no (?:encontrada|existe|disponible)|no se (?:pudo|ha podido|encontró)|acceso denegado|no tiene (?:acceso|permiso)|ha (?:ocurrido un error|fallado)|error del servidor|texto (?:de ejemplo|provisional)|aquí (?:irá|va)",
    r"(?:включите|разрешите) (?:javascript|js\b|скрипты|сценарии)|(?:требуется|нуж[ен]+о?|для работы нужен) (?:javascript|js\b)|страница (?:не найдена|временно|недоступна)|доступ запрещ|нет доступа|не удалось (?:загрузить|открыть|выполнить)|произош[её]?л[аи]? (?:ошибка|сбой)|сбой (?:при|в)\b|ошибка сервера|пример текста|текст-заполнитель|здесь будет",
))
NOTICE = 4  # segments of a short notice
OPENING = 16  # a phrase that starts within so many characters opens its segment

#: Parts that quote or explain: code between backticks.
QUOTED = r"`[^`\n]*`"
#: Fragments between marks, in text whose runs of letters are written A (capitals) or a.
_PART = r"[^{}\[\]<>()\"':,;\n]{0,30}"
_IN = rf"{_PART}[aA]{_PART}"
_SHAPE = rf"\{{\{{{_IN}\}}\}}|\{{%{_IN}%\}}|[$#]?\{{{_IN}\}}|\[\[{_IN}\]\]|\[{_IN}\]|<%=?{_IN}%>|<<{_IN}>>|<{_IN}>|%A(?:_+A)*%|__A(?:_+A)*__|@@{_IN}@@|«{_IN}»|\$a(?:[._-]a)*\$|\({_IN}\)|\.\.\.+"
_MARKUP = r"<(?!(?:USERNAME|PRICE|SELLER|BUYER|NAME|DATE|WALLET|AMOUNT)>)/?[A-Za-z][A-Za-z0-9]*(?:\s+[a-z]+=\"[^\"]*\")*\s*/?>"
_SAYS = r"[\p{L}\p{N}]"


def segments(documents: DataFrame) -> DataFrame:
    """(doc_id, source, pos, segment, title, chrome): lines and sentences of every text, without markup.

    title: the segment opens its text or stood in a heading. chrome: it is a heading or a line of links (three or more
    parts between bars). Null texts and segments without a letter or digit are left out.
    """
    parts = F.split(F.col("text"), r"(?:\r?\n)+|(?<=[.!?…;])\s+|(?=<(?i:title|h1|p)>)")
    rows = documents.select("doc_id", "source", F.posexplode(parts).alias("pos", "raw")).where(F.col("raw").rlike(_SAYS))
    plain = F.when(F.col("raw").contains("<"), F.trim(F.regexp_replace("raw", _MARKUP, " "))).otherwise(F.trim("raw"))  # placeholders written like tags stay
    heading = F.col("raw").rlike(r"^\s*#") | F.col("raw").rlike(r"(?i)<title>|<h1>")
    plain = F.when(plain.startswith("#"), F.regexp_replace(plain, r"^#+\s*", "")).otherwise(plain)
    rows = rows.select("doc_id", "source", "pos", plain.alias("segment"), ((F.col("pos") == 0) | heading).alias("title"), (heading | F.col("raw").rlike(r"\|[^|\n]+\|")).alias("chrome"))
    return rows.where(F.col("segment").rlike(_SAYS))


def weak_labels(documents: DataFrame, status: bool = True) -> DataFrame:
    """The segments with ``label``: MARKED, RESIDUE, SOUND or null where the rules don't say.

    Marked: it holds a placeholder outside quoted code. Residue: it opens with a phrase or states a response
    state (unless ``status`` is false: then it has no label), or stands in a text of which such segments hold over a
    third of the characters, or that is of at most NOTICE segments and opens with one. Sound: no segment of its text is residue. Phrases
    further on in a sentence are mentions, which sound texts have; texts of at most NOTICE segments that have one stay undecided.
    """
    rows = segments(documents)
    marked = F.when(F.col("segment").rlike(_HINT), F.regexp_replace("segment", QUOTED, " ").rlike(PLACEHOLDER)).otherwise(False)
    head = F.substring("segment", 1, OPENING + 40)
    said, stated = F.col("segment").rlike(PHRASES), F.col("segment").rlike(STATUS)
    opens = said & F.regexp_replace(head, r"^.{0," + str(OPENING) + r"}?(?=" + PHRASES.replace("(?iu)", "(?iu:", 1) + r"))", "\u0001").startswith("\u0001")
    rows = rows.withColumns({"marked": marked, "stated": stated, "said": said, "opens": opens})
    rows = rows.withColumn("residue", F.col("opens") | F.col("stated"))
    size = F.length("segment")
    body = ~F.col("chrome") | F.col("residue")
    body, text = ~F.col("chrome") | F.col("residue"), Window.partitionBy("doc_id")
    rows = rows.withColumns({
        "share": F.try_divide(F.sum(F.when(F.col("residue"), size).otherwise(0)).over(text), F.sum(F.when(body, size).otherwise(0)).over(text)),
        "any": F.max("residue").over(text), "mention": F.max("said").over(text), "short": F.count_if(body).over(text) <= NOTICE,
        "notice": F.min_by("residue", F.when(body, F.col("pos"))).over(text),
    })
    whole = ~F.col("chrome") & (F.coalesce(F.col("share") > 1 / 3, F.lit(False)) | F.coalesce(F.col("notice") & F.col("short"), F.lit(False)))
    label = F.when(F.col("marked"), MARKED).when(F.col("residue") | whole, RESIDUE).when(~F.col("any") & ~(F.col("mention") & F.col("short")), SOUND)
    if not status:
        label = F.when(~F.col("stated"), label)
    return rows.select("doc_id", "source", "pos", "segment", "title", "chrome", "stated", label.alias("label"))


def featured(rows: DataFrame) -> DataFrame:
    """Segments with hashed features: words, word pairs, shapes of marked fragments, length and title."""
    open_text = F.when(F.col("segment").contains("`"), F.regexp_replace("segment", QUOTED, " quotedcode ")).otherwise(F.col("segment"))
    rows = rows.withColumn("__open", open_text)
    flat = F.regexp_replace(F.lower("__open"), r"\d+", "9")
    rows = rows.withColumn("__words", F.array_remove(F.split(flat, r"[^\p{L}9_']+"), ""))
    # capitals are A, other letters a, so that a name of any length between marks has one form
    forms = F.regexp_replace(F.regexp_replace(F.regexp_replace("__open", r"\p{Lu}[\p{Lu}\d]+(?!\p{Ll})", "\u0001"), r"\p{L}[\p{L}\d]*", "a"), "\u0001", "A")
    shapes = F.when(F.col("__open").rlike(_HINT + r"|\.\.\."), F.regexp_extract_all(forms, F.lit(_SHAPE), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("__shapes", shapes)
    capital = (F.col("segment") == F.upper("segment")).cast("string")
    extra = F.array(F.concat(F.lit("size="), F.floor(F.log2(F.length("segment") + F.lit(1))).cast("string")), F.concat(F.lit("title="), F.col("title").cast("string")), F.concat(F.lit("caps="), capital), F.concat(F.lit("shapes="), F.least(F.size(F.array_remove("__shapes", "...")), F.lit(2)).cast("string")))
    rows = NGram(n=2, inputCol="__words", outputCol="__pairs").transform(rows)
    rows = rows.withColumn("__tokens", F.concat("__words", "__pairs", "__shapes", extra))
    rows = HashingTF(numFeatures=DIMENSIONS, binary=True, inputCol="__tokens", outputCol="features").transform(rows)
    return rows.drop("__open", "__words", "__shapes", "__pairs", "__tokens")


def _host_part() -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col("source"), F.lit(""))), F.lit(HELD_OUT))


def _dense(model: LogisticRegressionModel) -> LogisticRegressionModel:
    """The same model with its coefficients kept dense: a sparse matrix would be walked whole for every segment."""
    of = model._java_obj
    made = SparkSession.active()._jvm.org.apache.spark.ml.classification.LogisticRegressionModel
    return LogisticRegressionModel(made(of.uid(), of.coefficientMatrix().toDense(), of.interceptVector(), of.numClasses(), True))


def _fit(rows: DataFrame, steps: int) -> LogisticRegressionModel | None:
    """L2-regularised multinomial logistic regression on (label, n, features), each row counting n times; None where there are fewer than two classes.

    All rows are taken, weighted so that all sound ones together weigh PRIOR times each other class.
    """
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # three classes at most
    if len(counts) < 2:
        return None
    total = float(sum(counts.values()))
    weight = F.lit(0.0)
    for label, n in counts.items():
        mass = total * (PRIOR if label == SOUND else 1.0) / (PRIOR * (SOUND in counts) + len(set(counts) - {SOUND}))
        weight = F.when(F.col("label") == label, mass / n * F.col("n")).otherwise(weight)
    rows = rows.withColumn("weight", weight)
    return _dense(LogisticRegression(maxIter=steps, regParam=1e-5, elasticNetParam=0.0, standardization=False, weightCol="weight", family="multinomial", featuresCol="features", labelCol="label").fit(rows))


def train(documents: DataFrame, unseen: bool = False, status: bool = True) -> LogisticRegressionModel | None:
    """The classifier of segments, fitted on the weakly labelled segments of all documents; equal ones are one row that counts as often as they occur.

    It is fitted twice: segments that the rules couldn't decide take the first fit's class where that is SURE, so that
    wordings that stand beside those of the rules are learnt. With ``unseen`` one host in HELD_OUT isn't trained on, as
    validation needs. None where there is only one class.
    """
    chosen = documents.select("doc_id", "source", "text").where("text is not null")
    labelled = weak_labels(chosen.where(_host_part() > 0) if unseen else chosen, status)
    kinds = labelled.groupBy("segment", "title", "label").agg(F.count("*").alias("n"))
    rows = written(featured(kinds).select("label", "n", "features"), work_dir(documents.sparkSession, "residue"))
    first = _fit(rows.where("label is not null"), 30)
    if first is None:
        return None
    p = vector_to_array("probability")
    judged = first.transform(rows).select("features", "n", F.when(F.col("label").isNull() & (F.array_max(p) >= SURE), F.col("prediction")).otherwise(F.col("label")).alias("label"))
    return _fit(judged.where("label is not null"), 70)


def scored(model: LogisticRegressionModel, rows: DataFrame) -> DataFrame:
    """Segments with p_residue and p_marked."""
    p = vector_to_array("probability")
    out = model.transform(featured(rows))
    return out.withColumns({"p_residue": F.coalesce(F.get(p, F.lit(1)), F.lit(0.0)), "p_marked": F.coalesce(F.get(p, F.lit(2)), F.lit(0.0))}).drop("features", "rawPrediction", "probability", "prediction")


def residue_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, marked, share) of documents that hold residue.

    The classifier alone decides: a document is found if one of its segments is of the class of placeholders with
    probability CERTAIN, or if segments that are no sound text with that probability hold over CERTAIN of its characters. Headings and lines of
    links count towards the characters only if they are such segments themselves. All segments of all texts are
    scored in one narrow pass, and one row a document is shuffled. Null, empty and blank texts are never found; without two classes of weak
    labels there is nothing to learn from and nothing is found.
    """
    model = train(documents)
    if model is None:
        return documents.sparkSession.createDataFrame([], "doc_id bigint, marked boolean, share double")
    size = F.length("segment")
    hit = F.col("p_residue") + F.col("p_marked") >= CERTAIN
    by_doc = scored(model, segments(documents)).groupBy("doc_id").agg(
        F.max(F.col("p_marked") >= CERTAIN).alias("marked"), F.try_divide(F.sum(F.when(hit, size).otherwise(0)), F.sum(F.when(hit | ~F.col("chrome"), size).otherwise(0))).alias("share"),
    )
    return by_doc.where(F.col("marked") | (F.col("share") > CERTAIN))


def validation(documents: DataFrame) -> DataFrame:
    """(source, segments, residue_segments, precision, recall, stated_segments, stated_recall) on all documents of hosts that weren't trained on.

    precision and recall are against all weak labels. stated_recall is the recall of segments that state a response
    state by a second model, from whose training all such segments were left out: labels that no rule it learnt from has made.
    """
    model, blind = train(documents, unseen=True), train(documents, unseen=True, status=False)
    if model is None or blind is None:
        return documents.sparkSession.createDataFrame([], "source string, segments bigint, residue_segments bigint, precision double, recall double, stated_segments bigint, stated_recall double")
    chosen = documents.select("doc_id", "source", "text").where("text is not null").where(_host_part() == 0)
    unseen = weak_labels(chosen).where("label is not null")
    unseen = scored(model, unseen).withColumn("hit", F.col("p_residue") + F.col("p_marked") >= CERTAIN).drop("p_residue", "p_marked")
    unseen = scored(blind, unseen).withColumn("blind_hit", F.col("p_residue") + F.col("p_marked") >= CERTAIN)
    true, stated = F.col("label") != SOUND, F.col("stated") & (F.col("label") == RESIDUE)
    return unseen.groupBy("source").agg(
        F.count("*").alias("segments"), F.count_if(true).alias("residue_segments"),
        F.try_divide(F.count_if(F.col("hit") & true), F.count_if("hit")).alias("precision"), F.try_divide(F.count_if(F.col("hit") & true), F.count_if(true)).alias("recall"),
        F.count_if(stated).alias("stated_segments"), F.try_divide(F.count_if(stated & F.col("blind_hit")), F.count_if(stated)).alias("stated_recall"),
    )
