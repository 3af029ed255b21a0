"""Problem 10: the language of documents and of their mixed segments, by compression.

One zstandard raw-content dictionary per language is trained here: short seed texts
sort a bounded sample of labelled documents sentence by sentence, the sorted sentences
become the dictionaries, and the sample is sorted again by those. Each sentence of each
document is then compressed with every dictionary of its script; the smallest result
names the language, and a narrow margin names none.

Defined results: null, empty or wordless texts have no language and no segment; code,
tables, headings, file names and quoted phrases are left out; a text without a whole
sentence is judged as one piece for its document language only; documents of any length
are read whole; equal documents get equal rows; extra columns are not carried.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.runtime import fan_out

# The languages told apart, with other spellings of their labels.
LANGUAGES = {
    "en": "eng english",
    "de": "deu ger german deutsch",
    "fr": "fra fre french français francais",
    "es": "spa spanish español espanol castilian",
    "pt": "por portuguese português portugues",
    "it": "ita italian italiano",
    "nl": "nld dut dutch nederlands",
    "ru": "rus russian русский",
    "zh": "zho chi cmn chinese mandarin 中文",
    "ja": "jpn japanese 日本語",
}
_CODES = {name: code for code, names in LANGUAGES.items() for name in (code, *names.split())}

#: Seed texts, own sentences on everyday work; they only sort the sample.
SEEDS = {
    "en": "The results are written to a file when the work is done. There is no need to send this twice, because nobody has changed it since then. Each of them should be kept as it was, and you may ask for another one if it is missing. Before you start, check that all of the lists have been closed. It took less than an hour to find out where the error came from. Only people with access can read what was said about that. How many of those would you use, and which do you think is best? If you want to know more about these settings, look at the last page of this guide.",
    "de": "Die Ergebnisse werden in eine Datei geschrieben, wenn die Arbeit fertig ist. Es ist nicht nötig, das zweimal zu senden, weil niemand etwas daran geändert hat. Jeder von ihnen soll so bleiben, wie er war, und man kann einen anderen verlangen, wenn er fehlt. Vor dem Beginn sollte man prüfen, ob alle Listen geschlossen sind. Für die Suche nach dem Fehler brauchte der Dienst weniger als eine Stunde. Bitte lesen Sie diese Anleitung, bevor der Vorgang beendet wird. Wir haben gestern die Einträge nicht gefunden und sie danach wieder angelegt. Leider wusste man nicht mehr, woher das kam und wer es geschrieben hatte.",
    "fr": "Les résultats sont écrits dans un fichier lorsque le travail est terminé. Il n'est pas nécessaire d'envoyer cela deux fois, car personne ne l'a changé depuis. Chacun d'entre eux doit rester tel quel et l'on peut en demander un autre s'il manque. Avant de commencer, il faut vérifier que toutes les listes ont été fermées. Le service a mis moins d'une heure pour trouver d'où venait l'erreur. Nous avons lu ce guide hier et nous ne savons pas encore comment faire. Si la page n'est plus là, la recherche s'arrête après plusieurs essais. À la fin on peut voir une liste avec les lignes qui ont été modifiées.",
    "es": "Los resultados se escriben en un archivo cuando el trabajo ha terminado. No hay que enviar esto dos veces porque nadie lo ha cambiado desde entonces. Cada uno de ellos debe quedar como estaba y se puede pedir otro si falta. Antes de empezar conviene revisar que todas las listas estén cerradas. El servicio tardó menos de una hora en encontrar de dónde venía el error. Ayer leímos esta guía y todavía no sabemos cómo se hace. Si la página no está, la búsqueda se detiene después de varios intentos. Al final se muestra una lista con las líneas que han cambiado.",
    "pt": "Os resultados são escritos em um arquivo quando o trabalho termina. Não há motivo para enviar isso duas vezes, pois ninguém o mudou desde então. Cada um deles deve ficar como estava e você pode pedir outro se faltar. Antes de começar, convém verificar se todas as listas foram fechadas. O serviço levou menos de uma hora para descobrir de onde vinha o erro. Ontem lemos este guia e ainda não sabemos como fazer. Se a página não estiver lá, a busca para depois de várias tentativas. No fim aparece uma lista com as linhas que foram alteradas.",
    "it": "I risultati vengono scritti in un file quando il lavoro è finito. Non c'è bisogno di inviare questo due volte, perché nessuno lo ha cambiato da allora. Ognuno di essi deve restare com'era e se ne può chiedere un altro se manca. Prima di iniziare bisogna controllare che tutti gli elenchi siano chiusi. Il servizio ha impiegato meno di un'ora per capire da dove veniva l'errore. Ieri abbiamo letto questa guida e non sappiamo ancora come si fa. Se la pagina non c'è più, la ricerca si ferma dopo alcuni tentativi. Alla fine viene mostrata una lista con le righe che sono state modificate.",
    "nl": "De resultaten worden naar een bestand geschreven wanneer het werk klaar is. Het is niet nodig om dit twee keer te sturen, omdat niemand het sindsdien heeft veranderd. Elk van hen moet blijven zoals het was en je kunt een ander vragen als het ontbreekt. Controleer voor het begin of alle lijsten gesloten zijn. De dienst had minder dan een uur nodig om te vinden waar de fout vandaan kwam. Gisteren hebben we deze handleiding gelezen en we weten nog niet hoe het moet. Als de pagina er niet meer is, stopt het zoeken na enkele pogingen. Aan het einde staat er een lijst met de regels die zijn gewijzigd.",
    "ru": "Результаты записываются в файл, когда работа закончена. Нет нужды отправлять это дважды, потому что никто ничего не менял. Каждый из них должен остаться таким, каким был, и можно попросить другой. Перед началом проверьте, что все списки закрыты. Служба нашла ошибку меньше чем за час. Вчера мы читали эту инструкцию и ещё не знаем, как это делается. Если страницы нет, поиск прекращается после нескольких попыток. В конце показан список изменённых строк.",
    "zh": "工作完成以后，结果会写入文件。没有必要发送两次，因为没有人修改过它。每一个都应该保持原样，如果缺少可以再要一个。开始之前请检查所有列表是否已经关闭。服务用了不到一个小时就找到了错误的来源。昨天我们读了这份说明，还不知道怎么做。如果找不到页面，搜索会在几次尝试后停止。最后会显示修改过的行。",
    "ja": "作業が終わると、結果はファイルに書き込まれます。誰も変更していないので、二回送る必要はありません。それぞれはそのままにしておき、足りない場合は別のものを頼むことができます。始める前に、すべての一覧が閉じているか確認してください。サービスは一時間もかからずに間違いの原因を見つけました。昨日この説明を読みましたが、まだやり方が分かりません。ページがない場合、検索は何回か試した後に止まります。最後に変更された行の一覧が表示されます。",
}

#: Other languages of the same script: they compete for a sentence, and one that they win has none of the languages above.
RIVALS = {
    "uk": "Результати записуються у файл, коли робота закінчена. Немає потреби надсилати це двічі, бо ніхто нічого не змінював. Кожен із них має залишитися таким, яким був, і можна попросити інший. Перед початком перевірте, що всі списки закриті. Служба знайшла помилку менше ніж за годину. Учора ми читали цю інструкцію і ще не знаємо, як це робиться. Якщо сторінки немає, пошук припиняється після кількох спроб. Наприкінці показано список змінених рядків.",
    "bg": "Резултатите се записват във файл, когато работата е завършена. Няма нужда това да се изпраща два пъти, защото никой не е променил нищо. Всеки от тях трябва да остане такъв, какъвто беше, и може да се поиска друг. Преди началото проверете дали всички списъци са затворени. Услугата намери грешката за по-малко от час. Вчера четохме това ръководство и още не знаем как се прави. Ако страницата я няма, търсенето спира след няколко опита. Накрая се показва списък с променените редове.",
    "sr": "Резултати се уписују у датотеку када је посао завршен. Није потребно да се ово шаље два пута, јер нико ништа није променио. Сваки од њих треба да остане онакав какав је био, и може се тражити други. Пре почетка проверите да ли су све листе затворене. Служба је нашла грешку за мање од једног сата. Јуче смо читали ово упутство и још не знамо како се то ради. Ако странице нема, претрага се зауставља после неколико покушаја. На крају се приказује списак измењених редова.",
}

#: Documents sampled per label, sampled characters of each (of a longer one a stretch from a place its id's hash gives), bytes of a dictionary: the bounds of training.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 200, 20_000, 48_000
LEVEL, MARGIN, LEAST_WORDS = 5, 0.10, 4
#: The margin asked for against a rival, whose dictionary is but a seed text.
RIVAL_MARGIN = 0.03

_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)", re.S | re.M)
_INLINE = re.compile(r"`[^`\n]*`|https?://\S+|<[^<>\n]{1,200}>")
_QUOTED = re.compile(r"\"[^\"\n]{1,300}\"|«[^»\n]{1,300}»|»[^«\n]{1,300}«|„[^“”\n]{1,300}[“”]|“[^”\n]{1,300}”|「[^」\n]{1,300}」|『[^』\n]{1,300}』|‹[^›\n]{1,300}›")
_NAME = re.compile(r"[（(]?\b[\w/-]*[A-Za-z]\w*\.(?:md|csv|json|txt|ya?ml|db|ods|log|html?|xml|css|svg|zip|po|lst|rst|toml|xlsx|ini|tsv|py|js|sh|go)\b(?::\d+)?[)）]?", re.I)
_SKIP = re.compile(r"^\s*(?:#{1,6}\s|\||[-*_=]{3,}\s*$|\*\*[^*\n]{1,60}\*\*\s*\S{0,12}\s*(?:\([^)]*\))?\s*$)")
_BULLET = re.compile(r"^\s*(?:>\s*)*(?:[-*+•]\s+|\d{1,3}[.)]\s+)?")
_END = re.compile(r"(?<=[.!?])[\"')\]]*\s+|(?<=[。！？])")
_WORD = re.compile(r"[^\W\d_]+")
_CJK = re.compile("[぀-ヿ㐀-鿿]")
_CYR = re.compile("[Ѐ-ӿ]")
_LAT = re.compile("[A-Za-zÀ-ɏ]")
#: Letters of Russian that none of the RIVALS has.
_NO_RIVAL = re.compile("[ыэё]")
_DIGITS = re.compile(r"\d+")


def folded(s: str) -> str:
    """Lower case with every number as 0: what dictionaries hold and sentences are compressed as."""
    return _DIGITS.sub("0", s.lower())


def label_code(label: str | None) -> str | None:
    """The language a label names in any usual spelling, None if it names none of those known."""
    if not label:
        return None
    return _CODES.get(re.split(r"[-_ (]", label.strip().lower())[0])


def sentences(text: str) -> list[tuple[str, bool]]:
    """The running text's sentences in order and whether each is whole: ended, with enough words."""
    out = []
    plain = _QUOTED.sub(" ", _INLINE.sub(" ", _FENCE.sub("\n\n", text.replace("\r\n", "\n").replace("\r", "\n"))))
    block: list[str] = []
    for line in [*plain.split("\n"), ""]:
        bullet = _BULLET.match(line)
        rest = line[bullet.end() :].strip() if bullet else line.strip()
        skip = not rest or _SKIP.match(line) or _SKIP.match(rest)
        fresh = skip or bullet and any(c not in "> \t" for c in bullet.group())
        if fresh and block:
            for s in _END.split(_NAME.sub(" ", " ".join(block))):
                s = " ".join(s.split())
                if s and (_LAT.search(s) or _CJK.search(s) or _CYR.search(s)):
                    out.append((s, whole(s)))
            block = []
        if not skip:
            block.append(rest)
    return out


def whole(s: str) -> bool:
    if s.rstrip("\"')]）")[-1:] not in tuple(".!?。！？"):
        return False
    cjk = len(_CJK.findall(s))
    return cjk >= 6 or len(_WORD.findall(s)) >= LEAST_WORDS


def candidates(s: str) -> tuple[str, ...]:
    """The known languages written in the script most of the sentence is in."""
    cjk, cyr, lat = 3 * len(_CJK.findall(s)), len(_CYR.findall(s)), len(_LAT.findall(s))
    if cjk >= max(cyr, lat):
        return ("zh", "ja")
    return ("ru",) if cyr > lat else ("en", "de", "fr", "es", "pt", "it", "nl")


class Classifier:
    """Compression with one dictionary per language."""

    def __init__(self, contents: dict[str, bytes], level: int = LEVEL):
        self.contents, self.level = contents, level
        self._engines = None
        self._seen: dict[tuple[str, float], tuple[str | None, float]] = {}

    def __getstate__(self):
        return {"contents": self.contents, "level": self.level, "_engines": None, "_seen": {}}

    def _ready(self) -> dict:
        if self._engines is None:
            self._engines = {}
            for code, content in self.contents.items():
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.level)
                self._engines[code] = zstandard.ZstdCompressor(dict_data=d, level=self.level, write_checksum=False, write_content_size=False, write_dict_id=False)
        return self._engines

    def sizes(self, s: str) -> dict[str, int]:
        data = s.encode()
        engines = self._ready()
        known = candidates(s)
        return {c: len(engines[c].compress(data)) for c in (*known, *(RIVALS if known == ("ru",) else ()))}

    def classify(self, s: str, margin: float = MARGIN) -> tuple[str | None, float]:
        """(language or None, confidence): confidence is the saving of the best against the second dictionary."""
        s = folded(s)
        known = self._seen.get((s, margin))
        if known is None:
            ranked = sorted(self.sizes(s).items(), key=lambda x: (x[1], x[0]))
            if _NO_RIVAL.search(s):  # no rival can have written it, however well it compresses
                ranked.sort(key=lambda x: x[0] in RIVALS)
            (best, least), (second, more) = ranked[:2]
            gap = max(0.0, (more - least) / max(1, more))
            need = margin if second in LANGUAGES else 0.0 if _NO_RIVAL.search(s) else min(margin, RIVAL_MARGIN)
            known = (best if best in LANGUAGES and gap >= need else None, gap)
            if len(self._seen) > 200_000:
                self._seen.clear()
            self._seen[(s, margin)] = known
        return known


def _units(s: str) -> list[str]:
    """Words, and pairs of neighbouring characters where words are not spaced."""
    return _WORD.findall(s) if not _CJK.search(s) else [s[i : i + 2] for i in range(len(s) - 1)]


def _sorted_by_words(pool: dict[str, Counter]) -> dict[str, list[str]]:
    """Sentences by the language their words are most usual in, over the labels of the documents they stand in.

    Most labels are right, so a word's counts per label show its language although some
    documents are mislabelled or mixed. Sentences without a clear lead are left out.
    """
    counts: dict[str, Counter] = {c: Counter() for c in LANGUAGES}
    for code, seed in SEEDS.items():
        for s, _ in sentences(seed):
            counts[code].update(_units(folded(s)))
    for code, found in pool.items():
        for s in found:
            counts[code].update(_units(s))
    totals = {c: sum(n.values()) + 1 for c, n in counts.items()}
    kept: dict[str, list[str]] = defaultdict(list)
    for s in sorted({s for found in pool.values() for s in found}):
        units = _units(s)
        score = sorted(((sum(math.log((counts[c][u] + 0.05) / totals[c]) for u in units), c) for c in candidates(s)), reverse=True)
        if len(score) == 1 or score[0][0] - score[1][0] > 4:
            kept[score[0][1]].append(s)
    return kept


def train(samples: dict[str, list[str]], budget: int = DICTIONARY_BYTES) -> Classifier:
    """Dictionaries from documents by label; wrong labels and mixed documents are sorted out sentence by sentence."""
    pool: dict[str, Counter] = defaultdict(Counter)
    for code in sorted(samples):
        for text in samples[code]:
            for s, full in sentences(text):
                if full:
                    pool[code][folded(s)] += 1
    kept = _sorted_by_words(pool)
    contents = {}
    for code, seed in SEEDS.items():
        chosen, size = [], 0
        for s in sorted(kept[code], key=lambda x: (xxhash.xxh64_intdigest(x), x)):
            size += len(s.encode()) + 1
            if size > budget:
                break
            chosen.append(s)
        contents[code] = "\n".join([folded(seed), *chosen]).encode()
    return Classifier(contents | {code: folded(seed).encode() for code, seed in RIVALS.items()})


def sample(documents: DataFrame, per_label: int = SAMPLE_DOCS) -> dict[str, list[str]]:
    """At most per_label documents of each label's language, picked by the hash of their id. Bounded: SAMPLE_DOCS x SAMPLE_CHARS x languages."""
    names = F.create_map(*[F.lit(x) for pair in _CODES.items() for x in pair])
    code = F.try_element_at(names, F.element_at(F.split(F.lower(F.trim("lang")), r"[-_ (]"), 1))
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1).cast("bigint")).cast("int") + 1
    stretch = F.substring("text", start, F.lit(SAMPLE_CHARS))
    labelled = documents.select("doc_id", code.alias("code"), stretch.alias("text")).filter(F.col("code").isNotNull() & (F.length("text") > 0))
    order = Window.partitionBy("code").orderBy(F.xxhash64("doc_id"), "doc_id")
    # The row number is limited before the shuffle as well (group limit), so no label is gathered whole.
    picked = labelled.select("code", "doc_id").withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= per_label).select("doc_id", "code")
    rows = labelled.join(F.broadcast(picked.select("doc_id")), "doc_id").select("code", "doc_id", "text").collect()
    out: dict[str, list[str]] = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["code"], r["doc_id"])):
        out[r["code"]].append(r["text"])
    return out


SEGMENTS = "doc_id bigint, label string, segment_no int, first_sentence int, last_sentence int, words int, whole int, lang string, confidence double"


def _segmenter(model: Classifier):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, label, text in zip(batch["doc_id"], batch["lang"], batch["text"]):
                rows += [(doc, label_code(label), *s) for s in segments(text, model)]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SEGMENTS.split(", ")])
            yield out

    return run


def segments(text: str | None, model: Classifier) -> list[tuple]:
    """(segment_no, first_sentence, last_sentence, words, whole, lang, confidence): runs of sentences in one language."""
    found = sentences(text) if text else []
    judged = []
    for k, (s, full) in enumerate(found):
        if full or len(found) == 1:
            code, gap = model.classify(s)
            if code:
                judged.append((k, code, min(1.0, gap), max(len(_WORD.findall(s)), len(_CJK.findall(s)) // 2, 1), int(full)))
    out: list[list] = []
    for k, code, gap, n, full in judged:
        if out and out[-1][5] == code:
            last = out[-1]
            last[6] = (last[6] * last[3] + gap * n) / (last[3] + n)
            last[2], last[3], last[4] = k, last[3] + n, last[4] + full
        else:
            out.append([len(out), k, k, n, full, code, gap])
    return [tuple(x) for x in out]


def language_segments(documents: DataFrame) -> DataFrame:
    """The mixed-language segments of every document, with confidence."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "text")
    model = train(sample(docs))
    return fan_out(docs.filter(F.length("text") > 0)).mapInPandas(_segmenter(model), SEGMENTS)


def document_languages(documents: DataFrame) -> DataFrame:
    """(doc_id, label, lang, share, confidence, languages): each document's main language; a document without one has no row."""
    per = language_segments(documents).groupBy("doc_id", "label", "lang").agg(F.sum("words").alias("words"), (F.sum(F.col("confidence") * F.col("words")) / F.sum("words")).alias("confidence"))
    best = per.groupBy("doc_id", "label").agg(F.max(F.struct("words", "confidence", "lang")).alias("b"), F.sum("words").alias("all"), F.count("*").alias("languages"))
    return best.select("doc_id", "label", "b.lang", (F.col("b.words") / F.col("all")).alias("share"), "b.confidence", "languages")


def mislabelled(documents: DataFrame) -> DataFrame:
    """(doc_id, lang): the languages of mixed documents, and of documents whose label does not name their language."""
    seen = language_segments(documents).filter("whole > 0").groupBy("doc_id").agg(F.max("label").alias("label"), F.collect_set("lang").alias("langs"))
    wrong = seen.filter((F.size("langs") > 1) | F.col("label").isNull() | (F.col("label") != F.col("langs")[0]))
    return wrong.select("doc_id", F.explode("langs").alias("lang"))
