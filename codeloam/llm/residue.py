"""Problem 10: template residue, filler, error pages and script notices instead of content."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows
from .prose import SEEDS

#: Phrases of error pages, failed services, script notices and stand-in text, by kind, in lower case.
PHRASES = {
    "error": """explanation unavailable|the model service did not respond in time|did not respond in time|please retry later|rate limit exceeded|too many requests|request id
oops!|something went wrong|on our side|on our end|try again in|try again later|please try again|minutes|the requested page|the requested url|could not be shown|could not be found|was not found on this server|was not found|does not exist|page not found|reference
access to this page was denied|access to this page has been denied|access denied|permission denied|you don't have permission|please go back|contact the site owner|contact the administrator|internal server error|service unavailable|service temporarily unavailable|the service is temporarily unavailable|the service is currently unavailable|bad gateway|gateway timeout|gateway time-out|bad request|not found|forbidden|unauthorized|an error occurred|an error has occurred|unexpected error|while processing your request|no response from the model|the model returned no answer|quota exceeded|session expired|your session has expired|please log in|please sign in|to continue|connection timed out|request timed out|failed to load|failed to generate|could not be generated|no explanation available|analysis failed|unable to connect|the server
der dienst ist zurzeit nicht erreichbar|ist zurzeit nicht erreichbar|derzeit nicht verfügbar|nicht erreichbar|bitte versuchen sie es später erneut|versuchen sie es später|die angeforderte seite|wurde nicht gefunden|nicht gefunden|zugriff verweigert|bitte melden sie sich an|melden sie sich an|etwas ist schiefgelaufen|ein fehler ist aufgetreten|interner serverfehler|zu viele anfragen|keine berechtigung|fehler
le service est momentanément indisponible|momentanément indisponible|service indisponible|est indisponible|veuillez réessayer plus tard|réessayer plus tard|la page demandée|est introuvable|introuvable|accès refusé|accès interdit|veuillez vous connecter|une erreur est survenue|une erreur s'est produite|erreur interne du serveur|trop de requêtes|erreur|la page
el servicio no está disponible en este momento|no está disponible|en este momento|inténtelo más tarde|inténtelo de nuevo|no se encuentra la página|la página solicitada|no se ha encontrado|no encontrada|acceso denegado|inicie sesión para continuar|inicie sesión|algo ha salido mal|se ha producido un error|ha ocurrido un error|error interno del servidor|demasiadas solicitudes
o serviço não está disponível|serviço indisponível|tente novamente mais tarde|a página solicitada|não foi encontrada|não encontrada|acesso negado|faça login para continuar|algo deu errado|ocorreu um erro|erro interno do servidor""",
    "scripts": """please enable javascript|enable javascript|in your browser|to view this page|to continue using this|to use this app|to run this app|this site needs javascript|this site requires javascript|this page requires javascript|requires javascript|javascript is required|javascript is disabled|javascript must be enabled|loading|you need to enable javascript|you need to turn on scripts|turn on scripts|turn on javascript|your browser does not support|please activate javascript|scripts are disabled|enable scripts
bitte aktivieren sie javascript|aktivieren sie javascript|um diese seite zu sehen|um diese seite anzuzeigen|diese seite benötigt javascript|javascript ist deaktiviert|in ihrem browser|wird geladen
veuillez activer javascript|activez javascript|pour afficher cette page|cette page nécessite javascript|dans votre navigateur|javascript est désactivé|chargement
active javascript|en su navegador|para ver esta página|esta página necesita javascript|esta página requiere javascript|javascript está desactivado|habilite javascript|cargando
ative o javascript|habilite o javascript|no seu navegador|para ver esta página|esta página precisa de javascript|carregando""",
    "filler": """lorem ipsum|dolor sit amet|consectetur adipiscing elit|this is sample text|replace it with your own words|before you publish the page|before publishing|this is placeholder text|placeholder text|this text will be replaced|sample text|your text here|add your text here|content goes here|text goes here|click here to edit|dummy text|filler text|coming soon|under construction|this page is under construction|just another website|hello world! welcome to
dies ist ein blindtext|dies ist ein beispieltext|hier steht ihr text|hier kommt ihr text hin|ersetzen sie ihn|ersetzen sie diesen text|vor der veröffentlichung|bevor sie die seite veröffentlichen|durch ihre eigenen worte|durch ihren eigenen text|platzhaltertext|hier steht später|der eigentliche text|blindtext|beispieltext|der vor dem veröffentlichen ersetzt wird|wird noch ersetzt|mustertext
ceci est un texte d'exemple|ceci est un texte de remplissage|texte de remplissage|ceci est un faux texte|faux texte|remplacez-le par|vos propres mots|avant de publier|avant la publication|qui sera remplacé|votre texte ici|contenu à venir|à remplacer
este es un texto de relleno|texto de relleno|texto de ejemplo|que se cambiará antes de publicar|antes de publicar|sustitúyalo por|sus propias palabras|su texto aquí|próximamente|en construcción
este é um texto de exemplo|este é um texto provisório|texto de preenchimento|substitua-o|suas próprias palavras|seu texto aqui|em breve|em construção""",
}
#: Words of the usual filler in made-up Latin, and Latin sentences that show how its words are built.
LATIN = """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam
quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat
nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum
sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo
nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit sed quia consequuntur magni dolores eos qui ratione voluptatem sequi nesciunt
neque porro quisquam est qui dolorem ipsum quia dolor sit amet consectetur adipisci velit sed quia non numquam eius modi tempora incidunt ut labore et dolore magnam aliquam quaerat voluptatem
at vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti quos dolores et quas molestias excepturi sint obcaecati cupiditate non provident
temporibus autem quibusdam et aut officiis debitis aut rerum necessitatibus saepe eveniet ut et voluptates repudiandae sint et molestiae non recusandae itaque earum rerum hic tenetur a sapiente delectus
gallia est omnis divisa in partes tres quarum unam incolunt belgae aliam aquitani tertiam qui ipsorum lingua celtae nostra galli appellantur hi omnes lingua institutis legibus inter se differunt
gallos ab aquitanis garumna flumen a belgis matrona et sequana dividit horum omnium fortissimi sunt belgae propterea quod a cultu atque humanitate provinciae longissime absunt
arma virumque cano troiae qui primus ab oris italiam fato profugus lavinaque venit litora multum ille et terris iactatus et alto vi superum saevae memorem iunonis ob iram
multa quoque et bello passus dum conderet urbem inferretque deos latio genus unde latinum albanique patres atque altae moenia romae musa mihi causas memora quo numine laeso
in principio creavit deus caelum et terram terra autem erat inanis et vacua et tenebrae erant super faciem abyssi et spiritus dei ferebatur super aquas dixitque deus fiat lux et facta est lux
et vidit deus lucem quod esset bona et divisit lucem a tenebris appellavitque lucem diem et tenebras noctem factumque est vespere et mane dies unus
quo usque tandem abutere catilina patientia nostra quam diu etiam furor iste tuus nos eludet quem ad finem sese effrenata iactabit audacia nihilne te nocturnum praesidium palati nihil urbis vigiliae nihil timor populi
in nova fert animus mutatas dicere formas corpora di coeptis nam vos mutastis et illas adspirate meis primaque ab origine mundi ad mea perpetuum deducite tempora carmen
odi profanum vulgus et arceo favete linguis carmina non prius audita musarum sacerdos virginibus puerisque canto eheu fugaces labuntur anni nec pietas moram rugis et instanti senectae adferet
vivamus mea lesbia atque amemus rumoresque senum severiorum omnes unius aestimemus assis soles occidere et redire possunt nobis cum semel occidit brevis lux nox est perpetua una dormienda
pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas vestibulum tortor quam feugiat vitae ultricies eget tempor sit amet ante donec eu libero sit amet quam egestas semper
aenean ultricies mi vitae est mauris placerat eleifend leo quisque sit amet est et sapien ullamcorper pharetra vestibulum erat wisi condimentum sed commodo vitae ornare sit amet wisi
vivamus lectus magna fringilla urna porttitor rhoncus dolor purus non enim praesent elementum facilisis leo vel fringilla est ullamcorper eget nulla facilisi etiam dignissim diam quis enim lobortis"""
#: Part of a passage that must be matched, by characters, and its least size.
COVERED, LEAST = 0.6, 12
#: Words from which on a sentence is tried as Latin.
WORDS = 8
_FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)")
#: Messages that follow a status number.
STATUS = "not found|forbidden|unauthorized|unauthorised|bad gateway|bad request|gateway timeout|gateway time-out|service unavailable|service temporarily unavailable|internal server error|too many requests|gone|method not allowed|request timeout|request time-out|payment required|conflict|not acceptable"
_STATUS = re.compile(rf"(?i)\W*(?:http\s+|error:?\s+|status:?\s+)?[45]\d\d\s*[:\-–|]?\s*(?:{STATUS})\W*")
#: How unfilled placeholders begin, in lower case. The automaton finds them; a pattern then tells whether one stands there.
MARKS = "{{ ${ {% <% @@ %% [% ## __ xx_ %( [[ <insert <add <enter <your <replace [".split()
_UNFILLED = re.compile(
    r"\{\{\{?\s*[\w.\-|\s]{1,60}\s*\}?\}\}|\$\{\s*[\w.\-]{1,60}\s*\}|\{%[^%\n]{1,80}%\}|<%=?[^%\n]{1,80}%>|@@[A-Za-z_][\w.\-]*@@|%%[A-Za-z_]\w*%%|\[%[^%\n]{1,60}%\]|(?<!\w)##[A-Z][A-Z_]+##|(?<!\w)__[A-Z][A-Z_]{2,}__(?!\w)"
    r"|(?<!\w)XX_[A-Z][A-Z0-9_]*_XX(?!\w)|%\([A-Za-z_]\w*\)[sdrf](?!\w)|\[\[\s*[a-z]\w*(?:[:.][a-z]\w*)+\s*\]\]"
    r"|<(?:INSERT|ADD|ENTER|YOUR|REPLACE)[ _][A-Z0-9 _]{2,60}>|\[(?:INSERT|ADD|ENTER|YOUR|REPLACE|TODO|TBD)\b[^\]\n]{0,60}\]"
    r"|(?i:\[(?:(?:please\s+)?(?:insert|add|enter|describe|write|put|replace|fill in)\b[^\]\n]{0,60}|[^\]\n]{0,60}\bgoes here|[^\]\n]{1,60}\bhere|your [a-z ]{2,40}|hier\b[^\]\n]{0,60}|[^\]\n]{0,60}\beinfügen|[^\]\n]{0,60}\bici|(?:insérer|insérez|décrire|décrivez|ajouter|ajoutez|saisir|saisissez|écrire|écrivez)\b[^\]\n]{0,60}|[^\]\n]{0,60}\baquí|(?:insertar|insertad|inserte|describir|describa|añadir|añada|escribir|escriba)\b[^\]\n]{0,60}|[^\]\n]{0,60}\baqui|(?:inserir|insira|descrever|descreva|escrever|escreva)\b[^\]\n]{0,60}|tbd|todo)\](?!\())"
)
#: Words of sentences whose subject is a placeholder, so that it is meant to be there.
_SUBJECT = re.compile(
    r"(?i)\b(?:templates?|placeholders?|variables?|snippets?|renderer|(?:words|marks|markers|tags) such as|authors? writes?|site builder|syntax|escaped?|interpolat\w+|vorlagen?|platzhalter|gabarits?|plantillas?|marcador(?:es)?|espaces? réservés?)\b"
)
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=\S)|\n+")
_WORD = re.compile(r"[^\W\d_]+")
_QUOTED = re.compile(r"`[^`\n]+`|[\"“«„][^\"”»“\n]{3,80}[\"”»“]")
_LEAD = "#>*-•| \t"


@cache
def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, text in PHRASES.items():
        for phrase in text.replace("\n", "|").split("|"):
            out.add_word(phrase, (kind, len(phrase)))
    for mark in MARKS:
        out.add_word(mark, (None, len(mark)))
    out.make_automaton()
    return out


def lowered(text: str) -> str:
    """In lower case, each character in its own place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Matches:
    """What the automaton finds in a text: phrases by their places, and places where a placeholder may begin."""

    def __init__(self, text: str) -> None:
        self.text = text
        low = lowered(text)
        self.hits: list[tuple[int, int, str]] = []
        self.marks: list[int] = []
        for end, (kind, n) in _automaton().iter(low):
            start = end + 1 - n
            if kind is None:
                self.marks.append(start)
            elif not (low[start - 1 : start].isalnum() or low[end + 1 : end + 2].isalnum() and low[end].isalnum()):
                self.hits.append((start, end + 1, kind))
        self.hits.sort()
        self._starts = [s for s, _, _ in self.hits]

    def placeholders(self) -> Iterator[tuple[int, int]]:
        for at in sorted(set(self.marks)):
            m = _UNFILLED.match(self.text, at)
            if m:
                yield m.span()

    def phrases(self, a: int, b: int) -> str | None:
        """The kind of the phrases that cover most of the letters between two places, if they do."""
        inside = [(s, e, k) for s, e, k in self.hits[bisect_left(self._starts, a) : bisect_left(self._starts, b)] if e <= b]
        if not inside:
            return None
        longest: dict[str, int] = {}
        matched, reached = 0, a
        for s, e, kind in inside:
            longest[kind] = max(longest.get(kind, 0), e - s)
            matched += sum(c.isalpha() for c in self.text[max(s, reached) : e])
            reached = max(reached, e)
        if max(longest.values()) < LEAST and matched < 2 * LEAST or matched < LEAST * 0.75:
            return None
        return max(longest, key=longest.get) if matched >= COVERED * sum(c.isalpha() for c in self.text[a:b]) else None


class Latinity:
    """How much likelier a word is in Latin than in the likeliest other language, in nats, by character trigrams."""

    def __init__(self) -> None:
        self.models = [self._model(LATIN), *(self._model(SEEDS[k]) for k in ("en", "de", "fr", "es", "pt"))]
        self.known: dict[str, float] = {}

    @staticmethod
    def _model(text: str) -> tuple[Counter, Counter, Counter, int]:
        three, two, one = Counter(), Counter(), Counter()
        for w in _WORD.findall(text.lower()):
            w = f"  {w} "
            for k in range(2, len(w)):
                three[w[k - 2 : k + 1]] += 1
                two[w[k - 2 : k]] += 1
                one[w[k]] += 1
        return three, two, one, one.total()

    @staticmethod
    def _log(model: tuple[Counter, Counter, Counter, int], gram: str) -> float:
        three, two, one, n = model
        return math.log((three[gram] + 3 * (one[gram[2]] + 0.5) / (n + 20)) / (two[gram[:2]] + 3))

    def __call__(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            w = f"  {word} "
            scores = [sum(self._log(m, w[k - 2 : k + 1]) for k in range(2, len(w))) for m in self.models]
            found = scores[0] - max(scores[1:])
            if len(self.known) >= 200_000:
                self.known.clear()
            self.known[word] = found
        return found


@cache
def _latinity() -> Latinity:
    return Latinity()


def is_filler(passage: str) -> bool:
    """Latin, or one word or two said over and over."""
    words = _WORD.findall(passage.lower())
    if len(words) >= 6 and len(set(words)) <= 2 and all(a == b for a, b in zip(words, words[2:])):
        return sum(map(len, words)) >= 0.5 * len(passage.replace(" ", ""))
    return len(words) >= WORDS and "`" not in passage and sum(map(_latinity(), words)) > 0


def residue_spans(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the passages that are residue, in lines and, where a line isn't, in its sentences."""
    if not text or not text.strip():
        return
    # Fenced code is blanked, so that places stay.
    prose = _FENCE.sub(lambda m: "\n" * len(m[0]), text) if "```" in text or "~~~" in text else text
    found = Matches(prose)
    borders = [0, *(m.end() for m in _SENTENCE.finditer(prose)), len(prose)]
    for s, e in found.placeholders():
        a = bisect_right(borders, s) - 1
        sentence = prose[borders[a] : borders[min(a + 1, len(borders) - 1)]]
        if not _SUBJECT.search(_UNFILLED.sub(" ", sentence)):
            yield s, e, "placeholder"
    at = 0
    for line in prose.split("\n"):
        a, b, at = at, at + len(line), at + len(line) + 1
        while a < b and prose[a] in _LEAD:
            a += 1
        while b > a and prose[b - 1].isspace():
            b -= 1
        if b - a < 8:
            continue
        kind = _passage(prose, found, a, b, "`" in prose[a:b])
        if kind:
            yield a, b, kind
        elif b - a > 40:
            lower = a
            for m in [*_SENTENCE.finditer(prose, a, b), None]:
                upper = m.start() if m else b
                if upper - lower >= 20 and (lower, upper) != (a, b):
                    kind = _passage(prose, found, lower, upper, bool(_QUOTED.search(prose, lower, upper)))
                    if kind:
                        yield lower, upper, kind
                lower = m.end() if m else b


def _passage(prose: str, found: Matches, a: int, b: int, quoting: bool) -> str | None:
    """The kind of a passage; phrases in one that quotes or names code are what it is about."""
    if _STATUS.fullmatch(prose, a, b):
        return "error"
    if is_filler(prose[a:b]):
        return "filler"
    return None if quoting else found.phrases(a, b)


def residue(text: str) -> str | None:
    """placeholder, filler, error or scripts if a passage of the text is residue, else None."""
    return next((kind for _, _, kind in residue_spans(text)), None)


def residue_share(text: str) -> tuple[str, float] | None:
    """Kind of the first passage that is residue, and the share of the text's printed characters in all of them."""
    spans = sorted(residue_spans(text))
    if not spans:
        return None
    inside, reached = 0, 0
    for s, e, _ in spans:
        inside += sum(not c.isspace() for c in text[max(s, reached) : e])
        reached = max(reached, e)
    return residue(text), inside / sum(not c.isspace() for c in text)


def find_residue(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, share) of the documents of which a passage is leftover instead of content.

    Phrases in several languages and the beginnings of placeholders are found by one
    automaton. A line or sentence is residue where phrases cover most of it; a placeholder is
    wherever no sentence speaks about it. ``share`` is the part of the document that such
    passages take. Fenced code is no passage. NULL, empty and white-space texts are no cases;
    repeated rows count once; other columns are ignored.
    """
    rows = documents.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")

    def judge(doc_id, text):
        found = residue_share(text)
        return [(doc_id, *found)] if found else []

    return map_rows(rows, judge, "doc_id long, kind string, share double").groupBy("doc_id").agg(F.max(F.struct("share", "kind")).alias("r")).select("doc_id", "r.kind", "r.share")


def without_residue(documents: DataFrame, above: float = 0.0) -> DataFrame:
    """(doc_id) of the documents of which residue takes at most ``above`` of the text, NULL and empty texts among them."""
    rows = documents.select("doc_id", "text").filter("doc_id IS NOT NULL")

    def keep(doc_id, text):
        found = residue_share(text or "")
        return [] if found and found[1] > above else [(doc_id,)]

    return map_rows(rows, keep, "doc_id long").distinct()
