"""Quality rules (operator 4), line first, in DataFrame functions only.

Each line with a word is held to navigation, symbol, shouting, boilerplate and punctuation rules. A line is
navigation if it is a bare link, a menu label, or short items between separators without a sentence mark;
boilerplate and labels are known in English, German, French and Spanish, as phrases that prose has no use
for. Scripts that don't end sentences with marks are spared the punctuation rule. Failing lines are removed; a document is rejected if it fails a base rule (too few words, or too many words in
repeated 5-word windows) or if its remaining lines hold under ``MIN_LEFT`` percent of its text.

Everything is computed within a row, so nothing is shuffled and no key can be skewed. Window keys are
64-bit hashes of the five words; all work within a row is linear or n log n in its words.

Defined results: a null or empty text has no words, fails the base rule and is rejected; repeated rows,
ids and null ids are kept as rows; extra columns are passed through by ``cleaned`` and ignored otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let

SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"
WINDOW, MIN_WORDS, MAX_REPEATED = 5, 10, 20
#: Percent of the text in lines with a word that must be left.
MIN_LEFT = 50
#: A line fails with two symbols or more, or a doubled exclamation mark, if it has over one in so many characters.
PER_SYMBOL, PER_SHOUT = 50, 50
#: A line this long needs a sentence mark; one this short may be boilerplate or navigation.
LONG_LINE, SHORT_LINE = 60, 160
#: Characters an item between separators has on average at most, and a menu label.
NAV_ITEM, LABEL = 30, 30
BOILERPLATE = "(?i)" + "|".join(
    [
        "(enable|requires|activate) javascript|javascript (is )?(disabled|required|enabled)|(use|uses|using|accept|our|these) cookies|cookie (policy|settings|consent|notice)|privacy policy",
        "terms (of|and) (use|service|conditions)|all rights reserved|subscribe (to|now|today|here)|(our|free|weekly|daily|the) newsletter|lorem ipsum|sign (in|up) (to|for|now|here|with)",
        "log ?in (to|here|with|or)|read more|click here|skip to (main )?content|back to top|share (this|on) (page|post|article|story|facebook|twitter)",
        "alle rechte vorbehalten|datenschutzerkl[äÄ]rung|(verwenden|verwendet|nutzt|akzeptieren) cookies|cookies (akzeptieren|zulassen|ablehnen)|nutzungsbedingungen|gesch[äÄ]ftsbedingungen",
        "newsletter (abonnieren|bestellen)|jetzt (anmelden|registrieren|abonnieren)|(hier|sie hier) klicken|klicken sie hier|weiterlesen|mehr (lesen|erfahren)|zum (seitenanfang|inhalt springen)|javascript (aktivieren|ist deaktiviert)",
        "tous droits r[éÉ]serv[éÉ]s|politique de (confidentialit[éÉ]|cookies)|(accepter|utilisons|utilise|refuser) (les |des )?cookies|conditions (g[éÉ]n[éÉ]rales|d'utilisation)|mentions l[éÉ]gales",
        "abonnez-vous|s'abonner [àÀ]|cliquez ici|lire la suite|en savoir plus|haut de (la )?page|aller au contenu|activer javascript",
        "todos los derechos reservados|pol[íÍ]tica de (privacidad|cookies)|(aceptar|utilizamos|usamos|rechazar) (las )?cookies|t[éÉ]rminos (de uso|y condiciones)|aviso legal",
        "suscr[íÍ]b(ete|ase)|suscribirse a|haga clic|haz clic|leer m[áÁ]s|seguir leyendo|volver arriba|ir al contenido|iniciar sesi[óÓ]n|activar javascript",
    ]
)
#: Whole lines that are labels of menus.
LABELS = """home|menu|main menu|contact|contact us|about|about us|search|login|log in|sign in|sign up|register|next|previous|next page|previous page|faq|help|sitemap|share|print|comments|top|archive|categories|tags
startseite|men[uü]|kontakt|über uns|suche|anmelden|abmelden|registrieren|weiter|zurück|impressum|hilfe|teilen|drucken|kommentare|nach oben|datenschutz|warenkorb
accueil|contactez-nous|à propos|recherche|connexion|se connecter|s'inscrire|suivant|précédent|aide|plan du site|partager|imprimer|commentaires|panier
inicio|menú|contacto|quiénes somos|acerca de|buscar|acceder|registrarse|siguiente|anterior|ayuda|mapa del sitio|compartir|imprimir|comentarios|carrito""".replace("men[uü]", "menü").replace("\n", "|").split("|")
SEPARATORS = r"[|»›>·•→]"
LINK, TWO_WORDS = r"^[\x20\x09-\x0D]*(https?://|www\.)", r"[^\x20\x09-\x0D][\x20\x09-\x0D]+[^\x20\x09-\x0D]"
#: Sentence marks of Latin, Greek, Cyrillic, CJK, Indic, Arabic, Ethiopic, Armenian, Burmese and Khmer text.
MARKS = r"[.!?:;…。！？।॥۔؟؛။៖។።՝։]"
#: Letters of scripts whose sentences end in a space.
UNMARKED = r"[฀-໿]"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def lines_of(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window found twice or more; windows are compared by hash."""

    def covered(keys: Column) -> Column:
        at = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twice = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["k"] == x["k"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["k"] == x["k"], F.lit(False)))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        steps = lambda p: F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
        return F.aggregate(let(let(at, starts), steps), F.lit(0), lambda a, x: a + x)

    def of(w: Column) -> Column:
        n = F.size(w)
        hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
        count = let(hashes, lambda keys: F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(covered(keys)))
        return F.struct(n.cast("long").alias("n_words"), F.when(n < WINDOW, F.lit(0)).otherwise(count).cast("long").alias("n_repeat_words"))

    return let(words, of)


def line_passes(line: Column) -> Column:
    size = F.length(line)
    symbols, marked = F.regexp_count(line, F.lit(SYMBOLS)), line.rlike(MARKS)
    between = F.regexp_count(line, F.lit(SEPARATORS))
    label = F.trim(F.lower(F.regexp_replace(line, SPACE, " "))).isin(LABELS)
    return ~(
        ((symbols >= 2) & (symbols * PER_SYMBOL > size))
        | (F.regexp_count(line, F.lit("!!")) * PER_SHOUT > size)
        | ((size >= LONG_LINE) & ~marked & ~line.rlike(UNMARKED))
        | ((size <= SHORT_LINE) & line.rlike(BOILERPLATE))
        | ((size <= SHORT_LINE) & ~marked & (between >= 2) & ((between + 1) * NAV_ITEM >= size))
        | ((size <= SHORT_LINE) & line.rlike(LINK) & ~line.rlike(TWO_WORDS))
        | ((size <= LABEL) & label)
    )


def _judged(docs: DataFrame, text_col: str, counts: bool) -> DataFrame:
    """docs with one struct column ``__tessera_q`` of what the rules say; counts are only needed where they are returned.

    The struct comes out of a generator, so the optimizer can't evaluate it again in a filter on it.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def lines(found: Column) -> Column:
        def told(kept: Column) -> Column:
            dup = [(F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines")]
            enough = (F.length(F.array_join(kept, "")) * 100 >= F.length(F.array_join(found, "")) * MIN_LEFT).alias("enough")
            return F.struct(*dup * counts, (F.size(found) - F.size(kept)).alias("n_bad_lines"), enough, kept.alias("lines"))

        return let(F.filter(found, line_passes), told)

    more = [F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols")]
    judged = F.struct(repeated_words(words_of(text)).alias("words"), let(lines_of(text), lines).alias("lines"), *more * counts)
    return docs.select("*", F.explode(F.array(judged)).alias("__tessera_q"))


_BASE = "(__tessera_q.words.n_words < {0} or 100 * __tessera_q.words.n_repeat_words > {1} * __tessera_q.words.n_words)".format(MIN_WORDS, MAX_REPEATED)
_KEPT = f"(not {_BASE} and __tessera_q.lines.enough)"


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_bad_lines)."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _judged(source, "text", True).selectExpr(
        "doc_id", "__tessera_q.words.n_words", "__tessera_q.word_chars", "__tessera_q.n_symbols", "__tessera_q.lines.n_dup_lines", "__tessera_q.words.n_repeat_words", f"{_BASE} base_failed", f"{_KEPT} kept", "__tessera_q.lines.n_bad_lines"
    )


def cleaned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with all their columns; the text is that of the lines that pass."""
    out = _judged(docs, text_col, False).where(F.expr(_KEPT))
    text = F.when(F.expr("__tessera_q.lines.n_bad_lines = 0"), F.col(text_col)).otherwise(F.array_join("__tessera_q.lines.lines", "\n"))
    return out.withColumn(text_col, text).drop("__tessera_q")
