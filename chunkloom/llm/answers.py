"""Defective question and answer pairs, by ordered rules.

The rules stay in the JVM. Only the one for answers that stop early needs more than its row: it asks how often the
last two words of an answer end a sentence anywhere in the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.session import spread

#: Words that stand for no answer, headings of answers, and words by which languages are told apart.
PLACEHOLDERS = "null|none|nil|nan|undefined|n/?a|tbd|todo|empty|unknown|no answer|no response|keine antwort|keine angabe|sin respuesta|pas de réponse|sans réponse|无|暂无|待定|没有答案"
HEADINGS = "(?:final |short )?answer|response|reply|result|antwort|ergebnis|réponse|résultat|respuesta|resultado|回答|答案|答"
#: The closed classes of words of each language (articles, pronouns, prepositions, conjunctions, particles) and
#: its forms of be, have, do, give and go.
WORDS = {
    "en": "the a an and or but nor not no of to in into on onto at by for from with without over under between through about as than then that this these those it its itself he she they them his her their we us our you your i me my who whom whose which what when where why how if because while until before after again so such is are was were be been being am have has had do does did done make makes give gives given go goes can cannot could will would shall should may might must there here all any both each few more most other some only own same too very",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber denn sondern nicht kein keine keinen keiner ist sind war waren sein bin wird werden wurde worden hat haben hatte hatten macht machen gibt geben geht tun tut kann können muss müssen soll sollen darf er sie es wir ihr ich man sich mich mir dich dir uns ihm ihn ihnen mein dein seine seinen seiner seinem ihre ihren ihrer unser in im an am auf aus bei beim mit nach von vom vor zu zum zur über unter durch für gegen ohne um bis seit als wie wenn weil dass ob da so nur auch noch schon sehr mehr hier dort dann danach zuerst wo was wer wen warum wann welche welcher welches welchen diese dieser dieses diesem diesen jede jeder jedes alle ihrem",
    "fr": "le la les l un une des du de d au aux et ou mais donc car ni ne pas plus est sont était été être a ont avoir avait fait font faire donne va peut peuvent doit il elle ils elles on nous vous je j tu se s sa son ses leur leurs mon ma mes ton votre notre ce c cet cette ces cela qui que qu quoi dont où quand comment pourquoi quel quelle quels quelles dans sur sous avec sans pour par en entre vers chez si puis ensuite après avant aussi très tout tous toute toutes deux y même comme",
    "es": "el la los las lo un una unos unas de del al a y e o u pero sino que no si sí es son era fue ser está están estar ha han haber hay hace hacen da va se su sus le les me te nos mi tu este esta estos estas ese esa eso esto aquel qué quién cómo cuándo dónde cuál por para con sin en entre sobre bajo desde hasta hacia según tras como más menos muy también ya después antes primero luego cuando donde porque todo toda todos todas otro otra uno dos",
}
#: Scripts by which texts are told apart before languages are.
SCRIPTS = {"ja": r"[\p{IsHiragana}\p{IsKatakana}]", "zh": r"\p{IsHan}", "ko": r"\p{IsHangul}", "cyrillic": r"\p{IsCyrillic}", "arabic": r"\p{IsArabic}", "greek": r"\p{IsGreek}", "hebrew": r"\p{IsHebrew}", "devanagari": r"\p{IsDevanagari}", "thai": r"\p{IsThai}"}
#: So many letters of a script, or words in Latin letters, show which script a text is in.
LEAST_LETTERS, LEAST_LATIN_WORDS = 4, 4
#: Words after which something must follow, so an answer that ends with one has not ended.
OPEN_WORDS = (
    "a|an|the|this|these|those|that|which|who|whose|of|to|in|into|on|at|by|for|from|with|without|and|or|but|nor|because|since|when|while|if|unless|until|is|are|was|were|be|been|has|have|had|its|their|his|her|our|your|my|than|as|so|not|can|cannot|could|will|would|must|should|may|might|does|do|did|then|whether|between|before|after|about|"
    "der|die|das|den|dem|des|ein|eine|einen|einem|einer|eines|und|oder|aber|weil|dass|wenn|ob|mit|ohne|für|von|vom|zum|zur|zu|im|in|am|an|auf|aus|bei|nach|über|unter|durch|ist|sind|wird|werden|hat|haben|kann|muss|soll|so|sich|sein|seine|ihr|ihre|nicht|als|wie|"
    "le|la|les|un|une|des|du|de|et|ou|mais|donc|car|que|qui|dont|où|si|dans|sur|sous|avec|sans|pour|par|au|aux|est|sont|a|ont|son|sa|ses|leur|leurs|ce|cette|ces|ne|se|en|"
    "el|los|las|una|unos|unas|del|y|o|pero|porque|cuando|con|sin|para|por|al|es|son|ha|han|su|sus|este|esta|estos|se|no|lo"
)
OPEN_TAIL = r"(?:是|(?<!是)的|把|和|与|或|在|为|被|将|对|从|向|了解|因为|由于|如果|但是|而且|并且|以及|然后|它|其)$"

#: Sentences that decline to answer, and sentences that may go with them.
REFUSALS = [
    r"^(?:i ?a?['’]?m |we are )?(?:very |so |really )?(?:sorry|afraid)\b.{0,60}\b(?:can ?not|can['’]?t|couldn['’]?t|unable|not able|won['’]?t|not allowed|do not|don['’]?t)\b",
    r"^(?:sorry|unfortunately|regrettably|apologies|i apologi[sz]e)?[, ]*(?:but )?(?:i|we) (?:can ?not|can['’]?t|could not|couldn['’]?t|am unable|am not able|are unable|won['’]?t|will not|must decline|have to decline|decline|refuse|do not have|don['’]?t have|do not know|don['’]?t know|do not feel|don['’]?t feel|would rather not|['’]?d rather not|prefer not|am not allowed|am not permitted)\b",
    r"^(?:sorry|unfortunately)[, ]+(?:but )?(?:no answer|this question|that)\b.{0,50}\b(?:can ?not|can['’]?t|not)\b",
    r"^as an? (?:\w+ ){0,3}(?:assistant|model|ai)\b.{0,40}\b(?:can ?not|can['’]?t|not able|unable|not allowed|won['’]?t|not permitted|don['’]?t|do not)\b",
    r"^no (?:answer|reply|information|response) (?:can|could|will|may) be (?:provided|given|offered|made)\b",
    r"\boutside (?:of )?what i(?:['’]?m| am) (?:allowed|able|permitted)\b",
    r"^(?:that|this) (?:question )?(?:is (?:something )?(?:i|we) (?:can ?not|can['’]?t)|can ?not be answered)\b",
    r"^(?:es )?tut mir (?:sehr )?leid\b",
    r"\b(?:kann|könnte|darf|möchte|werde|bin|muss) ich (?:\w+ ){0,3}(?:leider |nicht )",
    r"^(?:leider )?(?:ich (?:kann|darf|bin|möchte|weiß|habe)|kann ich|darf ich)\b.{0,60}\b(?:nicht|kein\w*|außerstande|ablehnen)\b",
    r"^leider\b.{0,50}\b(?:nicht|keine?)\b.{0,40}\b(?:beantworten|helfen|auskunft|möglich)\b",
    r"^(?:désolée?|je suis (?:vraiment )?désolée?|je regrette|malheureusement)\b",
    r"\bje ne (?:suis pas en mesure|peux pas|peux malheureusement pas|sais pas|puis|suis pas autorisé|souhaite pas|dispose pas)\b",
    r"^il (?:ne )?m['’]est (?:pas possible|impossible)\b",
    r"^(?:lo siento|lo lamento|lamentablemente|me temo|disculpa|perdón)\b",
    r"\bno (?:me es posible|puedo (?:ayudar|responder|contestar|proporcionar|dar)|estoy en condiciones|estoy autorizad[oa]|dispongo de)\b",
    r"^(?:很?抱歉|很遗憾|对不起|不好意思|非常抱歉)",
    r"(?:我|本人)(?:无法|不能|没有办法|没办法|不便|不被允许|拒绝)(?:回答|提供|协助|帮助|讨论|透露|说明|解释)",
]
ALONGSIDE = [
    r"^is there (?:anything|something) else\b",
    r"^(?:please|kindly|feel free|let me know|maybe|try|you (?:may|might|could|can))\b",
    r"^(?:bitte|gibt es sonst|kann ich sonst|fragen sie)\b",
    r"^(?:veuillez|merci|n['’]hésitez|puis-je|y a-t-il)\b",
    r"^(?:por favor|¿?(?:puedo|hay algo|necesitas))\b",
    r"^(?:请|还有(?:什么|其他)|如(?:果|有))",
]
CITATION = r"\[C\d+\]"
ZERO_WIDTH = r"[​‌‍⁠﻿­ 　]"
FENCED = r"(?s)```.*?(?:```|\z)"
ENDED = r"[.!?。！？…)）\]](?:[\"'”’»)\]）*_`]|\s)*\z"
#: Answers that are whole as they are, a yes or no and a line's number.
BRIEF = r"(?i)^(?:yes|no|yep|nope|true|false|correct|ja|nein|doch|oui|non|si|sí|verdadero|falso|是的|是|不是|不|对|没有|有)?[,，]?\s*(?:(?:on |in |at |auf |à la |en la |en )?(?:lines?|zeilen?|lignes?|líneas?|第|行)\s*\p{N}+\s*行?)?$"
#: Two words that end a sentence in at least this share of their occurrences are no abrupt end.
END_SHARE = 0.5
UNIT = r"\p{IsHan}|[\p{L}\p{M}_]+|\p{N}+"


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def plain(text: Column) -> Column:
    """The text without citation marks, zero-width characters and outer white space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, CITATION, " "), ZERO_WIDTH, " "), r"^\s+|\s+$", ""))


def bare(text: Column) -> Column:
    """Only the words of a text, in lower case, single blanks between."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}_]+", " "))


def is_empty(answer: Column, text: Column) -> Column:
    """No content: nothing, white space, markup, a heading or a placeholder."""
    t = F.regexp_replace(text, r"(?i)<!--.*?-->|</?[a-z][a-z0-9]*(?:\s[^<>]*)?/?>|&nbsp;", " ")
    t = F.lower(F.regexp_replace(F.regexp_replace(t, r"(?m)```\w*\s*$", " "), r"[\s*_#>`~|=\-+.…\\()\[\]{}<>\"'“”‘’]+", " "))
    t = F.regexp_replace(F.trim(t), r"\s*[:：]\s*$", " :")
    return answer.isNull() | F.regexp_like(F.trim(t), F.lit(rf"^:?$|^(?:{PLACEHOLDERS})(?: :)?$|^(?:{HEADINGS})(?: :)?$|^(?:{HEADINGS}) ?[:：] ?(?:{PLACEHOLDERS})$"))


def sentences(text: Column) -> Column:
    """The sentences of a text, in lower case, without lists' markers and quotes before them."""
    parts = F.split(F.regexp_replace(F.lower(text), r"([.!?。！？])(?:\s+|(?<=[。！？])|$)", "$1\n"), r"\n+")
    return F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"^[\s>*_#\"'“”-]+", ""))), lambda s: F.regexp_like(s, F.lit(r"[\p{L}\p{N}]")))


def is_refusal(text: Column) -> Column:
    """Declines, and gives no answer: every sentence declines or goes with declining, one declines."""
    any_of = lambda x, patterns: F.regexp_like(x, F.lit("|".join(f"(?:{p})" for p in patterns)))
    declined = lambda s: F.forall(s, lambda x: any_of(x, REFUSALS + ALONGSIDE)) & F.exists(s, lambda x: any_of(x, REFUSALS))
    return bound(sentences(F.regexp_replace(text, "`", "")), declined)


def asked_first(text: Column) -> Column:
    """An answer without the words that announce a repeated question."""
    return F.regexp_replace(text, r"(?i)^[\s*_>\"'#]*(?:(?:the |your )?question(?: was)?|you asked(?: me)?|frage|sie fragten|question posée|vous avez demandé|pregunta|preguntaste|问题|你问|您问)\s*[:：]", " ")


def is_copy(q: Column, a: Column) -> Column:
    """Nothing but the question: its words, once or again and again, with at most one in ten (or one) added, left out or changed.

    q and a are the words of question and answer, see bare().
    """
    words = lambda x: F.regexp_extract_all(x, F.lit(UNIT), 0)
    most = F.greatest(F.lit(3), F.length(q) * 0.35)

    def near(w: Column) -> Column:
        qw, aw = w["q"], w["a"]
        slack = F.greatest(F.lit(1), F.floor(F.size(qw) / 10))
        extra = F.size(F.filter(aw, lambda x: ~F.array_contains(qw, x)))
        lost = F.size(F.filter(qw, lambda x: ~F.array_contains(aw, x)))
        return (F.size(qw) >= 2) & (F.abs(F.size(aw) - F.size(qw)) <= slack) & (extra <= slack) & (lost <= slack) & (F.levenshtein(a, q) <= most)

    again = (F.length(a) > F.length(q)) & F.startswith(a, q) & (F.trim(F.replace(a, q, F.lit(""))) == "")
    # a difference in length beyond `most` already makes the distance greater
    close = F.when(F.abs(F.length(a) - F.length(q)) <= most, bound(F.struct(words(q).alias("q"), words(a).alias("a")), near)).otherwise(F.lit(False))
    return (F.length(q) > 0) & (close | again & (F.size(words(q)) >= 2))


def language(prose: Column) -> Column:
    """The script of a text, or in Latin letters its language; latin where that is unsure, null where too little is said.

    The language is the one of whose WORDS most occur, at least two and more than of any other.
    """
    t = F.lower(prose)
    counts = F.array(*[F.regexp_count(t, F.lit(v)) for v in SCRIPTS.values()])
    latin_words = F.regexp_count(t, F.lit(r"\p{IsLatin}+"))
    foreign = F.regexp_like(t, F.lit(r"[^\p{IsLatin}\p{IsCommon}\p{IsInherited}]"))

    def script(n: Column) -> Column:
        """The script with most letters, kana before Han; latin where there are far more Latin words."""
        letters = F.reduce(n, F.lit(0), lambda x, y: x + y)
        names = F.array(*[F.lit(k) for k in SCRIPTS])
        told = (letters >= LEAST_LETTERS) & (letters >= latin_words)
        return F.when(told, F.when(n[0] > 0, names[0]).otherwise(F.element_at(names, F.array_position(n, F.array_max(n)).cast("int")))).when(latin_words > 2 * letters, "latin")

    def latin(words: Column) -> Column:
        return bound(F.array(*[F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in v.split()]))) for v in WORDS.values()]), lambda hits: leading(hits, words))

    def leading(hits: Column, words: Column) -> Column:
        best = F.array_max(hits)
        clear = (best >= 2) & (F.size(F.filter(hits, lambda h: h == best)) == 1)
        names = F.array(*[F.lit(k) for k in WORDS])
        return F.when(clear, F.element_at(names, F.array_position(hits, best).cast("int"))).when(F.size(words) >= LEAST_LATIN_WORDS, "latin")

    known = bound(F.split(t, r"[^\p{L}\p{M}]+"), lambda w: latin(F.filter(w, lambda x: x != "")))
    return F.when(~foreign, known).otherwise(bound(bound(counts, script), lambda s: F.when(s == "latin", known).otherwise(s)))


def differs(said: Column, asked: Column) -> Column:
    """Whether an answer is in another script than its question, or both are in known languages that differ."""
    known = lambda x: x.isin(*WORDS)
    unsure = (said == "latin") & (known(asked) | (asked == "latin")) | (asked == "latin") & known(said)
    return F.coalesce((said != asked) & ~unsure, F.lit(False))


def prose(question: Column, text: Column) -> Column:
    """What an answer says in words: without the question it repeats, code, paths, and heads of lists that name the question."""
    t = F.replace(text, question, F.lit(" "))
    t = F.regexp_replace(F.regexp_replace(t, FENCED, " "), r"`[^`\n]*`(?::\d+)?", " ")
    return F.regexp_replace(F.regexp_replace(t, r"(?m)^\s*(?:[-*]|\d+\.)\s.*$", " "), r"\b\w++(?:[/.]\w++)++|\b[^\W_]++_\w++", " ")


def ending(text: Column) -> Column:
    """What must be checked for an abrupt end: the answer without citations, blocks of code counted as ended."""
    return F.regexp_replace(text, r"(?s)```.*?```", "。")


def breaks_off(answer: Column, text: Column) -> Column:
    """Structure that begins and does not end: code, names, brackets, lists, announcements, sentences."""
    fences = F.size(F.split(answer, "```")) % 2 == 0

    def unfinished(inline: Column) -> Column:
        ticks = F.size(F.split(inline, "`")) % 2 == 0
        return ticks | bound(F.regexp_replace(inline, r"`[^`]*`", "x"), open_end)

    def open_end(words: Column) -> Column:
        opened = F.regexp_count(words, F.lit(r"[(（]")) > F.regexp_count(words, F.lit(r"[)）]"))
        announced = F.regexp_like(words, F.lit(r"[:：,，;；、(（\[{=\-–—/&+][\s*_\"']*\z"))
        item = F.regexp_like(words, F.lit(r"(?:\A|\n)\s*(?:\d+[.)]|[-*•])[\s*_]*\z"))
        last = F.lower(F.regexp_extract(words, r"([\p{L}\p{M}'’]+)[\s*_]*\z", 1))
        open_word = F.array_contains(F.array(*[F.lit(w) for w in OPEN_WORDS.split("|")]), last) & (F.regexp_count(words, F.lit(UNIT)) > 2)
        return opened | announced | item | open_word | F.regexp_like(F.trim(words), F.lit(OPEN_TAIL))

    return fences | bound(F.regexp_replace(ending(text), r"(?s)```.*", ""), unfinished)


def units(text: Column) -> Column:
    """The words of a text for statistics: numbers are N, code is C, Han characters stand alone, and | ends a sentence."""
    t = F.regexp_replace(F.lower(text), r"`[^`\n]*`(?::\d+)?|\b[\w./-]+/[\w./-]+(?::\d+)?", " C ")
    t = F.regexp_replace(F.regexp_replace(t, r"\p{N}+", " N "), r"[.!?。！？…]+(?=\s|\z|[^\x00-\x7f])|\n+", " | ")
    return F.regexp_extract_all(t, F.lit(r"\p{IsHan}|[\p{L}\p{M}_'’]+|\|"), 0)


def unended(text: Column) -> Column:
    """The last two words of an answer that has no mark at its end, else null; also null for code, places, yes and no alone."""

    def last_pair(u: Column) -> Column:
        pair = F.concat_ws(" ", F.when(F.size(u) > 1, F.try_element_at(u, F.lit(-2))).otherwise("|"), F.try_element_at(u, F.lit(-1)))
        return F.when(F.exists(u, lambda x: x != "C"), pair)

    def of_end(t: Column) -> Column:
        marked = F.regexp_like(t, F.lit(ENDED))
        return F.when(~marked & ~F.regexp_like(t, F.lit(BRIEF)), bound(F.filter(units(t), lambda x: x != "|"), last_pair))

    return bound(ending(text), of_end)


def end_shares(rows: DataFrame) -> DataFrame:
    """(pair, share): how often two words in a row end a sentence, over all answers.

    Only ends that are marked count; where an answer stops without a mark its last pair is no evidence.
    """
    u = rows.select(units(ending(plain(F.col("answer")))).alias("u"))
    u = u.select(F.concat(F.array(F.lit("|")), "u").alias("u")).filter(F.size("u") > 2)
    pairs = u.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("u") - 2), lambda i: F.struct(F.element_at("u", i).alias("a"), F.element_at("u", i + 1).alias("b"), F.element_at("u", i + 2).alias("c")))).alias("x")).filter("x.b <> '|'")
    return pairs.groupBy(F.concat_ws(" ", "x.a", "x.b").alias("pair")).agg(F.avg(F.when(F.col("x.c") == "|", 1.0).otherwise(0.0)).alias("share"))


def defects(rows: DataFrame) -> DataFrame:
    """(row_id, defect, triggered): the defective answers, the first rule that holds and all that hold.

    In order: empty, refusal, copies_question, other_language, truncated. A null question matches no rule that needs
    it. Of repeated rows of a row_id the one received last counts. An empty table gives no rows; very long answers are read whole.
    """
    q, a = F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit(""))
    received = F.col("received_at") if "received_at" in rows.columns else F.lit(0)
    given = spread(rows.select("row_id", "question", "answer", received.alias("received")), "row_id")
    text = F.col("text")  # of all functions here: an answer as plain() gives it
    r = given.withColumn("text", plain(a)).withColumns({"answer_words": bare(asked_first(text)), "question_words": bare(q), "answer_prose": prose(q, text), "question_prose": F.regexp_replace(q, r"`[^`\n]*`", " ")})
    r = r.withColumns({"empty": is_empty(F.col("answer"), text), "refusal": is_refusal(text), "copies_question": is_copy(F.col("question_words"), F.col("answer_words")), "said": language(F.col("answer_prose")), "asked": language(F.col("question_prose")), "off": breaks_off(a, text), "pair": unended(text)})
    #: The texts are read where they lie; only what was found about them is shuffled. Of a row delivered again the last counts.
    found = ("empty", "refusal", "copies_question", "said", "asked", "off", "pair")
    r = r.groupBy("row_id").agg(F.max(F.struct("received", *found)).alias("f")).select("row_id", "f.*")
    shares = end_shares(given.filter("answer is not null"))
    #: Rows that need no look-up get keys of their own, so that they don't all meet in one task.
    key = F.coalesce("pair", F.concat(F.lit("\x00"), F.pmod(F.xxhash64("row_id"), F.lit(4096))))
    r = r.withColumn("key", key).join(shares.withColumnRenamed("pair", "key"), "key", "left")
    rules = {
        "empty": F.col("empty"),
        "refusal": F.col("refusal"),
        "copies_question": F.col("copies_question"),
        "other_language": differs(F.col("said"), F.col("asked")),
        "truncated": F.col("off") | (F.col("pair").isNotNull() & (F.coalesce("share", F.lit(0.0)) < END_SHARE)),
    }
    triggered = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
    r = r.select("row_id", triggered.alias("triggered")).filter(F.size("triggered") > 0)
    return r.select("row_id", F.element_at("triggered", 1).alias("defect"), "triggered")
