"""Problem 5: natural language in comments and literals, by a character-level hidden Markov model."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_records, spread
from .segments import comment_blocks, comment_text, segments, string_text

STATES = ("code", "en", "de", "fr", "es", "pt")
#: Training text of each state, written for this model.
SEEDS = {
    "code": """self.total_count += len(rows) * 2 - offset[i]; if (n == 0) { return null; } else { buf->next = head; }
def read_all(path, mode="rb"): for (int i = 0; i < size; i++) { x[i] = fn(y[i], 17); } import os.path as osp
const getUserName = async (ctx, userId) => await db.query(id); type T struct { m map[string]int } #include <stdio.h>
select id, user_id from order_items where price > 10 order by 3 limit 5; insert into t (a, b) values (1, 2); update t set a = 4
https://host.example/a/b?c=d&e=5 0x1f3c9a7be2 a8f5f167f44f4964e6c998dee827110c qk3J/x+9Zt== ^[a-z0-9_]+\\.(js|py)$ %s: %d {} ${name}
utf-8 v1.2.3-rc.4 en_us text/html; charset=x node_modules/pkg/index.js key: value, foo.bar.baz(qux) user-agent max_len min_val tmp_dir""",
    "en": """This module reads the settings and writes them back when they have changed. The caller must hold the lock before it is called.
We keep the old value because some clients still depend on it, although it will be removed in the next release. If there is no entry for the given name,
an empty list is returned and a warning is shown. Each of these rows has been checked by hand, so that nothing is lost while the server restarts.
Only the first match counts; all others are ignored without any message. It would be better to wait until the other side has finished its work.
What happens if two users open the same file at once? Please do not edit this file by hand, since your changes will be overwritten.
Use of this software is governed by the terms of the license that comes with it. The job failed after three attempts, and should be tried again later today.
When this happens, the queue grows faster than the worker can empty it, which is why the limit was raised from ten to twenty for every account in that group.
Checks whether both ends of the connection agree about their version, then sorts the results by date and sends them to whoever asked for them.
The report is sent once a week and lists every customer whose payment is late. Before the next release starts, the team compares both versions and removes whatever nobody needs.
An older client expects two values that differ, whenever the table is empty or the disk is almost full. Each night the server copies its cache, checks the index and warns the owner if a page is missing.
Until the timer has run out, the helper keeps the buffer open and rejects any new request, unless the user has confirmed it. At the end of the day the planner sorts the remaining work for all folders below the chosen one.
It follows the original order, renames the parts, splits the long ones and joins the rest without touching the data itself. This way it limits how much memory is used at least once per hour.
The importer updates its own counter, while the exporter measures how long an upload takes, repairs broken links and rebuilds the search index after a restart.
From the third attempt on, the parser ignores rows that arrive late, so the summary still counts everything as long as nobody waits for the slow path.""",
    "de": """Dieses Modul liest die Einstellungen und schreibt sie zurück, wenn sie sich geändert haben. Der Aufrufer muss die Sperre halten, bevor es aufgerufen wird.
Wir behalten den alten Wert, weil einige Kunden noch davon abhängen, obwohl er in der nächsten Version entfernt wird. Gibt es für den Namen keinen Eintrag,
so wird eine leere Liste zurückgegeben und eine Warnung angezeigt. Jede dieser Zeilen wurde von Hand geprüft, damit nichts verloren geht, während der Server neu startet.
Nur der erste Treffer zählt; alle anderen werden ohne Meldung übergangen. Es wäre besser zu warten, bis die andere Seite ihre Arbeit beendet hat.
Was geschieht, wenn zwei Benutzer dieselbe Datei gleichzeitig öffnen? Bitte diese Datei nicht von Hand ändern, da die Änderungen überschrieben werden.
Die Nutzung dieser Software unterliegt den Bedingungen der Lizenz, die ihr beiliegt. Der Auftrag ist nach drei Versuchen gescheitert und sollte später noch einmal versucht werden.
Wenn das geschieht, wächst die Warteschlange schneller, als der Dienst sie leeren kann, und deshalb wurde die Grenze für jedes Konto dieser Gruppe von zehn auf zwanzig erhöht.
Prüft, ob beide Seiten der Verbindung dieselbe Fassung haben, sortiert dann die Ergebnisse nach dem Datum und schickt sie an den, der danach gefragt hat.
Der Bericht wird einmal in der Woche verschickt und nennt jeden Kunden, dessen Zahlung zu spät kommt. Vor dem nächsten Lauf vergleicht die Gruppe beide Fassungen und entfernt, was niemand braucht.
Ältere Geräte erwarten zwei Werte, die nicht übereinstimmen, solange die Tabelle leer ist. Jede Nacht kopiert der Dienst seinen Speicher, prüft das Verzeichnis und meldet fehlende Seiten.
Bis die Zeit abgelaufen ist, behält die Anwendung das Feld offen und verwirft jede neue Anfrage, außer der Benutzer hat sie bestätigt. Am Ende des Tages ordnet der Planer die übrige Arbeit für alle Ordner.""",
    "fr": """Ce module lit les paramètres et les réécrit lorsqu'ils ont changé. L'appelant doit tenir le verrou avant que la fonction ne soit appelée.
Nous gardons l'ancienne valeur parce que certains clients en dépendent encore, bien qu'elle doive être supprimée dans la prochaine version. S'il n'y a pas d'entrée pour ce nom,
une liste vide est renvoyée et un avertissement s'affiche. Chacune de ces lignes a été vérifiée à la main, pour que rien ne soit perdu pendant que le serveur redémarre.
Seul le premier résultat compte ; tous les autres sont ignorés sans aucun message. Il vaudrait mieux attendre que l'autre côté ait fini son travail.
Que se passe-t-il si deux utilisateurs ouvrent le même fichier en même temps ? Merci de ne pas modifier ce fichier à la main, car vos changements seront écrasés.
L'usage de ce logiciel est régi par les termes de la licence qui l'accompagne. La tâche a échoué après trois essais et devrait être relancée plus tard dans la journée.
Quand cela arrive, la file grandit plus vite que le service ne peut la vider, c'est pourquoi la limite est passée de dix à vingt pour chaque compte de ce groupe.
Vérifie que les deux bouts de la connexion sont d'accord sur leur version, puis trie les résultats par date et les envoie à celui qui les a demandés.
Le rapport est envoyé une fois par semaine et nomme chaque client dont le paiement est en retard. Avant le prochain passage, l'équipe compare les deux versions et supprime ce dont personne n'a besoin.
Les anciens appareils attendent deux valeurs différentes, sauf si la table est vide. Chaque nuit le service copie sa mémoire, vérifie le dossier et signale les pages qui manquent.
Jusqu'à la fin du délai, le programme garde le champ ouvert et rejette toute nouvelle demande, à moins que l'utilisateur ne l'ait confirmée. À la fin de la journée, il range le travail qui reste.""",
    "es": """Este módulo lee los ajustes y los vuelve a escribir cuando han cambiado. Quien lo llama debe tener el cerrojo antes de que se ejecute.
Guardamos el valor antiguo porque algunos clientes todavía dependen de él, aunque se eliminará en la próxima versión. Si no hay ninguna entrada con ese nombre,
se devuelve una lista vacía y se muestra un aviso. Cada una de estas filas se ha revisado a mano, para que no se pierda nada mientras el servidor se reinicia.
Solo cuenta la primera coincidencia; todas las demás se pasan por alto sin ningún mensaje. Sería mejor esperar hasta que el otro lado haya terminado su trabajo.
¿Qué ocurre si dos usuarios abren el mismo fichero a la vez? Por favor, no modifique este fichero a mano, ya que los cambios se perderán.
El uso de este programa se rige por los términos de la licencia que lo acompaña. La tarea ha fallado después de tres intentos y debería repetirse más tarde.
Cuando esto sucede, la cola crece más deprisa de lo que el servicio puede vaciarla, y por eso el límite subió de diez a veinte para cada cuenta de ese grupo.
Comprueba que los dos extremos de la conexión tienen la misma versión, luego ordena los resultados por fecha y los envía a quien los ha pedido.
El informe se envía una vez por semana y nombra a cada cliente cuyo pago llega tarde. Antes de la próxima ejecución, el equipo compara las dos versiones y elimina lo que nadie necesita.
Los aparatos antiguos esperan dos valores distintos, salvo cuando la tabla está vacía. Cada noche el servicio copia su memoria, comprueba la carpeta y avisa de las páginas que faltan en la lista.
Hasta que se acabe el tiempo, la ventana mantiene el campo abierto y rechaza cualquier nueva petición, a no ser que el usuario la haya confirmado. Al final del día ordena el trabajo que queda.
La sesión bloquea la salida del almacén y la conexión con el registro sustituye la búsqueda por otra más rápida, así que los nuevos clientes siguen pudiendo entrar.""",
    "pt": """Este módulo lê as configurações e volta a gravá-las quando elas mudam. Quem o chama deve ter a trava antes que ele seja executado.
Mantemos o valor antigo porque alguns clientes ainda dependem dele, embora vá ser removido na próxima versão. Se não há nenhuma entrada com esse nome,
uma lista vazia é devolvida e um aviso é mostrado. Cada uma destas linhas foi conferida à mão, para que nada se perca enquanto o servidor reinicia.
Só conta a primeira ocorrência; todas as outras são ignoradas sem nenhuma mensagem. Seria melhor esperar até que o outro lado tenha acabado o seu trabalho.
O que acontece se dois usuários abrem o mesmo arquivo ao mesmo tempo? Por favor, não altere este arquivo à mão, pois as mudanças serão perdidas.
O uso deste programa é regido pelos termos da licença que o acompanha. A tarefa falhou depois de três tentativas e deveria ser repetida mais tarde.
Quando isso acontece, a fila cresce mais depressa do que o serviço consegue esvaziá-la, e por isso o limite passou de dez para vinte em cada conta desse grupo.
Confere se as duas pontas da ligação têm a mesma versão, depois ordena os resultados por data e os envia a quem os pediu, exceto nos dias de folga.
O relatório é enviado uma vez por semana e cita cada cliente cujo pagamento está atrasado. Antes da próxima execução, a equipe compara as duas versões e elimina o que ninguém precisa.
Os aparelhos antigos esperam dois valores diferentes, a não ser quando a tabela está vazia. Cada noite o serviço copia a sua memória, verifica a pasta e avisa das páginas que faltam na lista.
Até que acabe o tempo, a janela mantém o campo aberto e rejeita qualquer nova requisição, a menos que o usuário a tenha confirmado. No fim do dia, ordena o trabalho que resta das contas abertas.
A sessão bloqueia a saída do armazém e a conexão com o registro substitui a busca por outra mais rápida, de modo que os novos clientes ainda podem entrar no calendário da entrega.
Mova a fila de dados para o módulo de controle se o limite permitir e renove a cópia de reserva a cada nova etapa, enquanto ninguém estiver à espera do contador.""",
}
_LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäçèéêëìíîïñòóôõöùúûüßœ"
_OTHER = " ,.;:!?'-()\"" + "¿¡"
#: 0 pads, 1 is a digit, 2 a capital inside a word, 3 an underscore, 4 any other character.
SYMBOLS = {c: k + 5 for k, c in enumerate(_LETTERS + _OTHER)}
WIDTH = 80
#: Log-probabilities, at a character, of a change between code and a language and between two languages.
SWITCH, CHANGE = -6.0, -24.0
#: Part of the code model that is spread evenly over all symbols.
EVEN = 0.3
#: Segments labelled at once: their number and the characters of all.
ROWS, CELLS = 4096, 400_000
#: Characters of a block; longer texts are labelled in blocks side by side, with the same result.
SPAN = 4096
_SENTENCE = re.compile(r"(?<=[.!?;])\s+|\n\s*\n|\n(?=[ \t]*(?:[@:]\w|[-*•]\s))")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_QUERY = re.compile(r"\s*(?:select\b.*\bfrom|insert\s+into|update\b.*\bset|delete\s+from|create\s+(?:table|index|view)|alter\s+table|drop\s+table|with\b.*\bas\s*\()\b", re.I | re.S)
_TAG = re.compile(r"^[ \t]*[@:\\][A-Za-z].*$", re.M)


def symbols(text: str) -> np.ndarray:
    """Symbol numbers of a text, one for each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    base = _table()[np.minimum(points, 0x2FF)]
    upper = (base >= 128).astype(bool)
    base = base & 127
    inside = np.zeros(len(base), bool)
    letter = (base >= 5) & (base < 5 + len(_LETTERS))
    inside[1:] = upper[1:] & letter[:-1] & ~upper[:-1]
    base[inside] = 2
    return base


@cache
def _table() -> np.ndarray:
    out = np.full(0x300, 4, np.uint8)
    for p in range(0x300):
        c = chr(p)
        low = c.lower()
        if c.isdigit():
            out[p] = 1
        elif c == "_":
            out[p] = 3
        elif c.isspace():
            out[p] = SYMBOLS[" "]
        elif low in SYMBOLS:
            out[p] = SYMBOLS[low] + (128 if c != low else 0)
    return out


@cache
def emissions() -> np.ndarray:
    """Log-probabilities of a symbol after two others, [state, trigram], smoothed over shorter contexts."""
    out = np.empty((len(STATES), WIDTH**3), np.float32)
    for k, state in enumerate(STATES):
        text = unicodedata.normalize("NFC", SEEDS[state]).replace("\n", " ")
        s = symbols("  " + text).astype(np.int64)
        one = np.bincount(s, minlength=WIDTH) + (0.5 if state == "code" else 0.02)
        one = one / one.sum()
        two = np.bincount(s[:-1] * WIDTH + s[1:], minlength=WIDTH**2).reshape(WIDTH, WIDTH)
        two = (two + 4 * one) / (two.sum(1, keepdims=True) + 4)
        three = np.bincount((s[:-2] * WIDTH + s[1:-1]) * WIDTH + s[2:], minlength=WIDTH**3).reshape(WIDTH**2, WIDTH)
        three = (three + 6 * two[np.arange(WIDTH**2) % WIDTH]) / (three.sum(1, keepdims=True) + 6)
        if state == "code":
            three = (1 - EVEN) * three + EVEN / WIDTH
        out[k] = np.log(three).ravel()
    return out


def _context(grid: np.ndarray) -> np.ndarray:
    return (grid[:-2] * WIDTH + grid[1:-1]) * WIDTH + grid[2:]


def _step(score: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The best language of each column, and what the best ways into code and into a language are worth; last where the latter comes from."""
    top = score[1:].argmax(0) + 1
    high, code = score[top, columns], score[0]
    by_code, by_language = code + np.float32(SWITCH), high + np.float32(CHANGE)
    return top, high + np.float32(SWITCH), np.maximum(by_code, by_language), np.where(by_code >= by_language, 0, top)


def _filled(blocks: list[np.ndarray], before: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of blocks side by side, [place, block], and the sizes of the blocks."""
    sizes = np.array([len(b) for b in blocks])
    grid = np.zeros((int(sizes.max(initial=0)) + 2, len(blocks)), np.int64)
    for k, b in enumerate(blocks):
        grid[:2, k] = before[k]
        grid[2 : 2 + len(b), k] = b
    return _context(grid), sizes


def _transfer(blocks: list[np.ndarray], before: list[tuple[int, int]]) -> np.ndarray:
    """[block, state before, last state]: the score of the best path through each block between two states."""
    table, n = emissions(), len(STATES)
    trigram, sizes = _filled(blocks, before)
    score = np.full((n, len(blocks), n), -np.inf, np.float32)  # [last state, block, state before]
    score[np.arange(n), :, np.arange(n)] = 0
    score = score.reshape(n, -1)
    columns, out = np.arange(score.shape[1]), np.empty((len(blocks), n, n), np.float32)
    for t in range(len(trigram)):
        _, into_code, into_language, _ = _step(score, columns)
        score = np.concatenate([np.maximum(score[0], into_code)[None], np.maximum(score[1:], into_language)]) + np.repeat(table[:, trigram[t]], n, axis=1)
        for k in np.flatnonzero(sizes == t + 1):
            out[k] = score.reshape(n, -1, n)[:, k].T
    return out


def _paths(blocks: list[np.ndarray], before: list[tuple[int, int]], entered: np.ndarray, left: np.ndarray) -> list[np.ndarray]:
    """The best path through each block from the state ``entered`` to the state ``left``; -1 leaves it open, and code follows."""
    table, n = emissions(), len(blocks)
    trigram, sizes = _filled(blocks, before)
    longest = len(trigram)
    score = np.full((len(STATES), n), -np.inf, np.float32)
    columns = np.arange(n)
    score[entered, columns] = 0
    moved = np.zeros((longest, len(STATES), n), bool)
    best = np.zeros((longest, 2, n), np.int8)
    ended = np.zeros((len(STATES), n), np.float32)
    for t in range(longest):
        top, into_code, into_language, source = _step(score, columns)
        best[t, 0], best[t, 1] = top, source
        moved[t, 0] = score[0] < into_code
        moved[t, 1:] = score[1:] < into_language
        score = np.concatenate([np.maximum(score[0], into_code)[None], np.maximum(score[1:], into_language)]) + table[:, trigram[t]]
        here = sizes == t + 1
        if here.any():
            ended[:, here] = score[:, here]
    ended[1:] += np.float32(SWITCH)
    state = np.where(left < 0, ended.argmax(0), left)
    path = np.zeros((longest, n), np.int8)
    for t in range(longest - 1, -1, -1):
        active = sizes > t
        path[t, active] = state[active]
        back = active & moved[t, state, columns]
        state = np.where(back, best[t, np.minimum(state, 1), columns], state)
    return [path[: sizes[k], k] for k in range(n)]


def viterbi(texts: list[str]) -> list[np.ndarray]:
    """The state of each character of each text; a text begins and ends in code.

    Outside comments and literals a span's state can only be code, so the best path through
    a whole file is made of the best paths through its comments and literals. The path
    through a text of more than SPAN characters is put together from blocks: the best score
    of each block between any two states is found for many at once, the best states at the
    borders follow from these, and then the paths inside.
    """
    space = SYMBOLS[" "]
    encoded = [symbols(t) for t in texts]
    short = [k for k, s in enumerate(encoded) if len(s) <= SPAN]
    out: list[np.ndarray] = [np.empty(0, np.int8)] * len(texts)
    for k, path in zip(short, _paths([encoded[k] for k in short], [(space, space)] * len(short), np.zeros(len(short), np.int64), np.full(len(short), -1))):
        out[k] = path
    for k, s in enumerate(encoded):
        if len(s) > SPAN:
            out[k] = _long(s, space)
    return out


def _long(s: np.ndarray, space: int) -> np.ndarray:
    blocks = [s[a : a + SPAN] for a in range(0, len(s), SPAN)]
    before = [(space, space), *((int(s[a - 2]), int(s[a - 1])) for a in range(SPAN, len(s), SPAN))]
    many = max(1, CELLS // SPAN)
    scores = np.concatenate([_transfer(blocks[a : a + many], before[a : a + many]) for a in range(0, len(blocks), many)])
    reached, came = scores[0, 0].astype(np.float64), []
    for block in scores[1:].astype(np.float64):
        ways = reached[:, None] + block
        came.append(ways.argmax(0))
        reached = ways.max(0)
    reached[1:] += SWITCH
    states = [int(reached.argmax())]
    for where in reversed(came):
        states.append(int(where[states[-1]]))
    states.append(0)
    states = np.array(states[::-1])
    paths: list[np.ndarray] = []
    for a in range(0, len(blocks), many):
        b = min(a + many, len(blocks))
        paths += _paths(blocks[a:b], before[a:b], states[a:b], states[a + 1 : b + 1])
    return np.concatenate(paths)


def prose_candidates(text: str, extension: str, least: int) -> list[str]:
    """Texts of the comments and literals that could hold a sentence of ``least`` words."""
    found = segments(text, extension)
    out = []
    for block in comment_blocks(text, found):
        out.append(comment_text("\n".join(text[s:e] for s, e in block)))
    out.extend(string_text(text[s:e]) for kind, s, e in found if kind == "s" and e - s > 2 * least)
    keep = []
    for t in out:
        if t.count(" ") + t.count("\n") >= least - 1:
            t = _TAG.sub("", t)
            if not _QUERY.match(t) and len(_WORD.findall(t)) >= least:
                keep.append(unicodedata.normalize("NFC", t))
    return keep


def languages(text: str, path: np.ndarray, least: int) -> dict[int, int]:
    """State -> characters of the sentences of ``least`` words in that language."""
    out: dict[int, int] = {}
    at = 0
    for part in [*_SENTENCE.finditer(text), None]:
        end = part.start() if part else len(text)
        if end > at:
            words = [m.start() for m in _WORD.finditer(text, at, end)]
            if len(words) >= least:
                of = path[words]
                counts = np.bincount(of, minlength=len(STATES))
                k = int(counts[1:].argmax()) + 1
                if counts[k] >= least:
                    out[k] = out.get(k, 0) + int((path[at:end] == k).sum())
        at = part.end() if part else end
    return out


def file_languages(files: DataFrame, least: int = 6) -> DataFrame:
    """(file_id, lang, prose_chars, n_chars, share) of code records by language of their prose.

    Prose is a sentence of at least ``least`` words in a comment, docstring or literal;
    share is its part of the file's characters. NULL and empty texts give no row, a
    file_id delivered twice gives its rows once, other columns are ignored.
    """
    rows = spread(code_records(files).select("file_id", "extension", F.col("full_content").alias("text")).filter("file_id IS NOT NULL"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, extensions, texts = (c.to_pylist() for c in batch.columns)
            found: dict[tuple[int, int], int] = {}
            sizes = dict(zip(ids, map(len, texts)))
            pending = [(i, t) for i, e, t in zip(dict.fromkeys(ids), *_first(ids, extensions, texts)) for t in prose_candidates(t, e, least)]
            pending.sort(key=lambda x: len(x[1]))
            at = 0
            while at < len(pending):
                end = at + 1
                while end < len(pending) and end - at < ROWS and (end - at) * len(pending[end][1]) <= CELLS:
                    end += 1
                for (i, t), path in zip(pending[at:end], viterbi([t for _, t in pending[at:end]])):
                    for k, n in languages(t, path, least).items():
                        found[i, k] = found.get((i, k), 0) + n
                at = end
            if found:
                keys = sorted(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in keys], pa.int64()), pa.array([STATES[k] for _, k in keys]), pa.array([found[x] for x in keys], pa.int64()), pa.array([sizes[i] for i, _ in keys], pa.int64())],
                    ["file_id", "lang", "prose_chars", "n_chars"],
                )

    once = rows.mapInArrow(run, "file_id long, lang string, prose_chars long, n_chars long").groupBy("file_id", "lang").agg(F.max("prose_chars").alias("prose_chars"), F.max("n_chars").alias("n_chars"))
    return once.withColumn("share", F.col("prose_chars") / F.col("n_chars"))


def _first(ids: list, extensions: list, texts: list) -> tuple[list, list]:
    seen: dict = {}
    for i, e, t in zip(ids, extensions, texts):
        seen.setdefault(i, (e, t))
    return [e for e, _ in seen.values()], [t for _, t in seen.values()]
