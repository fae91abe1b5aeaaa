"""A token stream, gated: think blocks dropped, the first sentence held back until its language is judged.

Input rows (ask_id, seq, attempt, language, text, final) come from any stream. State is
kept by ask_id: what is held, whether the gate is open, which attempt runs. A first
sentence in the wrong language asks once for a restart; the second attempt passes as it
is. An answer's state is a mark once it has ended; with an event time it goes an hour
after the last token.
"""

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T

OUT = "ask_id string, seq long, name string, text string"
STATE = "held string, open boolean, attempt int, thinking string, done boolean"
#: fixed values: where a first sentence ends, and between how many characters it is judged
READY = re.compile(r"[.!?](?:\s|$)|[。！？\n]")
LEAST_HELD, MOST_HELD = 12, 120
IDLE_MS = 3_600_000


_HANGUL, _KANA, _HAN, _LATIN, _WORD = (re.compile(x) for x in (f"[{T.HANGUL_ALL}]", f"[{T.KANA}]", f"[{T.HAN}]", "[A-Za-zÀ-ɏ]", T.LATIN_WORD))


def _scripts(text: str) -> tuple[int, int]:
    """How many characters only traditional, and only simplified, Chinese has."""
    return sum(c in T.TRADITIONAL for c in text), sum(c in T.SIMPLIFIED for c in text)


def language_of(text: str) -> str | None:
    """A text's language by script, as functions.text.question_language has it, with the same tables."""
    hangul, kana, han = (len(x.findall(text)) for x in (_HANGUL, _KANA, _HAN))
    if hangul and hangul >= kana:
        return "ko"
    if kana:
        return "other"
    words, letters = len(_WORD.findall(text)), len(_LATIN.findall(text))
    other = sum(unicodedata.category(c)[0] == "L" for c in text) - han - letters
    if other > han + letters:
        return "other"
    if han and han >= words:
        traditional, simplified = _scripts(text)
        return "zh-Hant" if traditional > simplified else "zh-Hans"
    return "en" if words else "other" if other else None


def passes(text: str, language: str) -> bool:
    """Whether a first sentence counts as written in a language, as functions.text.is_in_language has it."""
    found = language_of(text)
    if found is None or found == language:
        return True
    if language == "en":
        return found not in ("ko", "other") and len(_HAN.findall(text)) <= len(_LATIN.findall(text))
    if language == "ko" or not found.startswith("zh"):
        return False
    traditional, simplified = _scripts(text)
    return not (traditional >= 3 and simplified == 0) if language == "zh-Hans" else not (simplified >= 3 and traditional == 0)


def ready(held: str) -> bool:
    return len(held) >= MOST_HELD or (len(held) >= LEAST_HELD and READY.search(held) is not None)


def without_think(pending: str, text: str) -> tuple[str, str]:
    """(what must still wait, what may go on) of a stream whose start may be a think block. None waiting is "-"."""
    if pending == "-":
        return "-", text
    own = (pending + text).lstrip()
    if own.startswith("<think>"):
        end = own.find("</think>")
        return (own, "") if end < 0 else ("-", own[end + 8 :].lstrip())
    return (own, "") if "<think>".startswith(own) else ("-", own)


def _gate(at: str | None):
    def gate(key: tuple, rows, state: GroupState):
        """One ask's events from its tokens."""
        if state.hasTimedOut:
            state.remove()
            return
        held, is_open, attempt, thinking, done = state.get if state.exists else ("", False, 1, "", False)
        out = []
        tokens = pd.concat(list(rows)).sort_values("seq")
        for r in tokens.itertuples():
            if done or r.attempt != attempt:
                continue
            thinking, text = without_think(thinking, r.text or "")
            if is_open:
                if text:
                    out.append((r.seq, "delta", text))
            else:
                held += text
                if r.final or ready(held):
                    if attempt == 1 and not passes(held, r.language):
                        out.append((r.seq, "restart", ""))
                        held, thinking, attempt = "", "", 2
                        continue
                    if held:
                        out.append((r.seq, "delta", held))
                    held, is_open = "", True
            if r.final:
                out.append((r.seq, "done", ""))
                done, thinking = True, ""
        state.update((held, is_open, attempt, thinking, done))
        if at:
            last = int(tokens[at].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + IDLE_MS)
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["ask_id", "seq", "name", "text"])

    return gate


def gated(stream: DataFrame, at: str | None = None, late: str = "10 minutes") -> DataFrame:
    """OUT for a stream of (ask_id, seq, attempt, language, text, final).

    at names an event time, by which old state goes; without it state stays, as a
    processing time would keep a stream that is to end waiting for ever.
    """
    kind = GroupStateTimeout.EventTimeTimeout if at else GroupStateTimeout.NoTimeout
    timed = stream.withWatermark(at, late) if at else stream
    return timed.groupBy("ask_id").applyInPandasWithState(_gate(at), OUT, STATE, "append", kind)
