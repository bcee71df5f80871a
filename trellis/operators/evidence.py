"""Documents to concepts with evidence: cleaning, n-grams, class-based weights, whole-word matches."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellis.functions.similarity import partial_ratio_udf
from trellis.functions.text import ngrams, words
from trellis.operators.ranking import global_index, top_per_key
from trellis.session import BROADCAST_ROWS, cut

#: Slots of the tables that n-grams are sifted by.
SLOTS = 1 << 20

#: The English stop words of the reference's vectorizer (scikit-learn's list). Fixed values.
STOP_WORDS = frozenset(
    (
        "a about above across after afterwards again against all almost alone along already also although always am among amongst amoungst amount an and another any anyhow anyone anything anyway anywhere are around as at "
        "back be became because become becomes becoming been before beforehand behind being below beside besides between beyond bill both bottom but by call can cannot cant co con could couldnt cry "
        "de describe detail do done down due during each eg eight either eleven else elsewhere empty enough etc even ever every everyone everything everywhere except few fifteen fifty fill find fire first five for former formerly forty found four from front full further "
        "get give go had has hasnt have he hence her here hereafter hereby herein hereupon hers herself him himself his how however hundred i ie if in inc indeed interest into is it its itself keep "
        "last latter latterly least less ltd made many may me meanwhile might mill mine more moreover most mostly move much must my myself name namely neither never nevertheless next nine no nobody none noone nor not nothing now nowhere "
        "of off often on once one only onto or other others otherwise our ours ourselves out over own part per perhaps please put rather re same see seem seemed seeming seems serious several she should show side since sincere six sixty so some somehow someone something sometime sometimes somewhere still such system "
        "take ten than that the their them themselves then thence there thereafter thereby therefore therein thereupon these they thick thin third this those though three through throughout thru thus to together too top toward towards twelve twenty two "
        "un under until up upon us very via was we well were what whatever when whence whenever where whereafter whereas whereby wherein whereupon wherever whether which while whither who whoever whole whom whose why will with within without would yet you your yours yourself yourselves "
    ).split()
)


def document_lines(lines: DataFrame, with_title: bool = False) -> DataFrame:
    """Lines origin|||title|||abstract or origin|||abstract (column value) to origin, title, abstract; blank and other lines skipped. with_title puts the title before the abstract."""
    p = F.split("value", r"\|\|\|")
    n = F.size(p)
    x = lines.where(F.trim("value") != "").where(n >= 2).select(F.trim(p[0]).alias("origin"), F.when(n >= 3, F.trim(p[1])).alias("title"), F.when(n >= 3, F.trim(F.try_element_at(p, F.lit(3)))).otherwise(F.trim(p[1])).alias("abstract"))
    return x.withColumn("abstract", F.trim(F.concat_ws(" ", "title", "abstract"))) if with_title else x


def domain_filter(text: Column, keywords: Sequence[str]) -> Column:
    """Any of the keywords occurs as it is written, whatever the case; no keywords match nothing."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(k.lower())) for k in keywords], F.lit(False))


def term_counts(docs: DataFrame, id_col: str, class_col: str, text_col: str, lo: int = 1, hi: int = 1, stop: Collection[str] = (), min_docs: int = 1, min_chars: int = 1) -> DataFrame:
    """How often each n-gram occurs in each class: class, term, n. Words of stop and of fewer than min_chars characters are dropped first, n-grams of fewer than min_docs documents (rows of docs with a class) last."""
    w = words(F.col(text_col))
    if stop:
        w = F.filter(w, lambda x: ~x.isin(*sorted(stop)))
    if min_chars > 1:
        w = F.filter(w, lambda x: F.length(x) >= min_chars)
    grams = ngrams(w, lo, hi)
    x = docs.where(F.col(class_col).isNotNull())
    if min_docs <= 1:
        return x.select(F.col(class_col).alias("class"), F.explode(grams).alias("term")).groupBy("class", "term").agg(F.count(F.lit(1)).alias("n"))
    # sorted, a document's first of equal n-grams counts the document; the array is bound once as a lambda's variable
    first = F.flatten(F.transform(F.array(F.sort_array(grams)), lambda g: F.transform(g, lambda t, i: F.struct(t.alias("term"), ((i == 0) | (F.get(g, i - 1) != t)).cast("int").alias("first")))))
    x = x.select(F.col(class_col).alias("class"), F.explode(first).alias("x")).groupBy("class", "x.term").agg(F.count(F.lit(1)).alias("n"), F.sum("x.first").alias("docs"))
    return x.withColumn("docs", F.sum("docs").over(Window.partitionBy("term"))).where(F.col("docs") >= min_docs).select("class", "term", "n")


def class_weights(counts: DataFrame, reduce_frequent: bool = False) -> DataFrame:
    """Class-based tf-idf of every term of every class: class, term, weight.

    tf is L1-normalised per class (its root with reduce_frequent); idf is ln(1 + A/f) with A the whole-numbered mean of words per class and f the term's total.
    Totals per class are few and broadcast; totals per term join by a shuffle that is already keyed by term.
    """
    per_class = counts.groupBy("class").agg(F.sum("n").alias("words"))
    mean = per_class.agg(F.floor(F.avg("words")).alias("a")).withColumn("k", F.lit(1))
    per_term = counts.groupBy("term").agg(F.sum("n").alias("f"))
    x = counts.join(per_term, "term").join(F.broadcast(per_class), "class").withColumn("k", F.lit(1)).join(F.broadcast(mean), "k")
    tf = F.col("n") / F.col("words")
    x = x.withColumn("weight", F.round((F.sqrt(tf) if reduce_frequent else tf) * F.ln(1 + F.col("a") / F.col("f")), 9))
    return x.select("class", "term", "weight")


def ctfidf(counts: DataFrame, k: int, reduce_frequent: bool = False) -> DataFrame:
    """The k best terms of each class by class_weights: class, term, weight, rank."""
    return top_per_key(class_weights(counts, reduce_frequent), ["class"], [F.desc("weight"), "term"], k)


def boosted(weights: DataFrame, ontology: DataFrame, boost: float = 0.5, k: int = 10) -> DataFrame:
    """Weights (class, term, weight; of all terms, as a term that is cut before cannot be lifted) with boost added for terms of the ontology, the k best of each class."""
    known = ontology.select(F.lower(F.trim("term")).alias("term")).distinct().withColumn("known", F.lit(1))
    x = weights.drop("rank").join(known, "term", "left").withColumn("weight", F.round(F.col("weight") + F.coalesce("known", F.lit(0)) * boost, 9)).drop("known")
    return top_per_key(x, ["class"], [F.desc("weight"), "term"], k)


def frequent_concepts(docs: DataFrame, text_col: str, k: int, lo: int = 1, hi: int = 3, min_docs: int = 2) -> DataFrame:
    """The k most frequent n-grams of words with at least four letters: concept, n; ties by concept."""
    w = F.filter(words(F.col(text_col)), lambda x: F.length(x) >= 4)
    x = docs.select(F.explode(ngrams(w, lo, hi)).alias("concept")).groupBy("concept").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    return x.orderBy(F.desc("n"), "concept").limit(k)


def concept_ids(concepts: DataFrame) -> DataFrame:
    """Concepts numbered from 1 in their order, without a global window."""
    return global_index(concepts.select("concept").distinct(), ["concept"], "id", 1)


def _anchored(phrases: DataFrame, n: int) -> DataFrame:
    """phrases (concept, phrase) with gram, the n-gram of the phrase that the fewest phrases hold."""
    p = phrases.select("phrase").distinct().select("phrase", F.explode(F.array_distinct(ngrams(F.split("phrase", " "), n, n))).alias("gram"))
    rarest = p.join(p.groupBy("gram").count(), "gram").groupBy("phrase").agg(F.min(F.struct("count", "gram")).alias("x")).select("phrase", "x.gram")
    return phrases.join(rarest, "phrase")


def evidence(concepts: DataFrame, docs: DataFrame, id_col: str, text_col: str, cap: int | None = 3, max_words: int = 4) -> DataFrame:
    """Documents that hold a concept as whole words: concept, doc, rank; the first cap by document id (all with None).

    Instead of a regular expression for every pair, documents explode into their distinct n-grams (as many words as
    concepts have, at most max_words), those that are concepts are kept where they arise, and the rest is an equality join.
    A concept of more words is met by the rarest of its n-grams of max_words words and then sought whole in the document. Concepts beyond
    BROADCAST_ROWS meet the n-grams by a shuffle, from which two broadcast tables of hash slots keep most n-grams that are no concept.
    """
    c = cut(concepts.select("concept", F.array_join(words(F.col("concept")), " ").alias("phrase")).where("phrase <> ''").distinct())
    length = F.size(F.split("phrase", " "))
    size = c.agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("longest"), F.max(F.when(length <= max_words, length)).alias("short")).first()
    small = size["n"] <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda x: x)
    text = docs.select(F.col(id_col).alias("doc"), words(F.col(text_col)).alias("w"))

    def grams(lo: int, hi: int) -> Column:
        return F.explode(F.array_distinct(ngrams(F.col("w"), lo, hi))).alias("gram")

    brief = c.where(length <= max_words).withColumnRenamed("phrase", "gram")
    long = hint(cut(_anchored(c.where(length > max_words), max_words))) if (size["longest"] or 0) > max_words else None
    whole, sought = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")), F.concat(F.lit(" "), F.col("phrase"), F.lit(" "))
    if small:  # documents stay where they are
        met = text.select("doc", grams(1, size["short"] or 1)).join(hint(brief), "gram").select("concept", "doc")
        if long is not None:
            held = text.select("doc", "w", grams(max_words, max_words)).join(long, "gram").where(F.contains(whole, sought))
            met = met.unionByName(held.select("concept", "doc"))
    else:  # n-grams move without their documents, and only those of which two hash slots are taken by some concept; a slot table has at most SLOTS rows whatever the concepts are
        wanted = brief.select("gram") if long is None else brief.select("gram").unionByName(long.select("gram"))
        x = text.select("doc", F.explode(ngrams(F.col("w"), 1, max_words if long is not None else size["short"] or 1)).alias("gram"))
        for seed in (1, 2):
            slot = F.pmod(F.xxhash64("gram", F.lit(seed)), F.lit(SLOTS)).cast("int")
            x = x.withColumn("slot", slot).join(F.broadcast(wanted.select(slot.alias("slot")).distinct()), "slot", "left_semi").drop("slot")
        x = cut(x.distinct())
        met = x.join(brief, "gram").select("concept", "doc")
        if long is not None:
            found = x.join(long, "gram").select("concept", "phrase", "doc")
            held = found.join(text.select(F.col("doc").alias("of"), whole.alias("t")), (F.col("doc") == F.col("of")) & F.contains(F.col("t"), sought), "left_semi")
            met = met.unionByName(held.select("concept", "doc"))
    if cap is None:
        return met.withColumn("rank", F.row_number().over(Window.partitionBy("concept").orderBy("doc")))
    return top_per_key(met, ["concept"], ["doc"], cap)


def fuzzy_evidence(concepts: DataFrame, docs: DataFrame, id_col: str, text_col: str, least: float = 70.0) -> DataFrame:
    """Documents with a window that resembles a concept: concept, doc, score of at least least.

    Sharing a word is no condition of partial similarity, so concepts, a stated list, meet all documents; they must be few.
    """
    c = concepts.select("concept").where("concept IS NOT NULL").distinct()
    if c.count() > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} concepts to be compared with every document")
    x = docs.select(F.col(id_col).alias("doc"), F.lower(F.col(text_col)).alias("t")).where("t <> ''").join(F.broadcast(c))
    return x.select("concept", "doc", F.round(partial_ratio_udf("concept", "t"), 6).alias("score")).where(F.col("score") >= least)


def gold_labels(concepts: DataFrame, gold: DataFrame) -> DataFrame:
    """concept, label: 1 for gold concepts, which are added where missing."""
    g = gold.select(F.lower(F.trim("concept")).alias("concept")).where("concept <> ''").distinct().withColumn("label", F.lit(1))
    return concepts.select("concept").distinct().join(g, "concept", "full_outer").select("concept", F.coalesce("label", F.lit(0)).alias("label"))


def ontology(concepts: DataFrame, semtypes: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Preferred English terms (lang EN, tty PT) of concepts (cid, tid, string, tty, lang) whose last semantic type (cid, sty) is wanted."""
    st = semtypes.groupBy("cid").agg(F.max("sty").alias("sty")).where(F.col("sty").isin(*wanted))
    x = concepts.where((F.col("lang") == "EN") & (F.col("tty") == "PT") & (F.trim("string") != ""))
    return x.join(st, "cid").select(F.trim("string").alias("term")).distinct()
