"""Restored text holds up against the counts, whatever the size of the collection and the pair of encodings."""

import pytest

from rankmill.llm import encodings as enc

SOUND = ["Функция читает файл только один раз, а затем вызывает очередь", "Размер ответа составляет сорок мегабайт, см. рисунок", "Größe und Maß für die Straße überprüft", "déjà vu à la façade naïve", "設定がない場合は値を返します"]


def model(copies):
    rows = {}
    for t in SOUND * copies:
        c = enc._class(enc._points(t)).tolist()
        for a, b in zip(c, c[1:], strict=False):
            if a > 127 or b > 127:
                rows[a, b] = rows.get((a, b), 0) + 1
    return enc.Model.of([(a, b, n) for (a, b), n in rows.items()])


@pytest.mark.parametrize("copies", [5, 50, 500])
def test_pairings(copies):
    """Of every pairing of Cyrillic encodings that can hold the phrase, what is called whole is the phrase."""
    m, phrase, right, total = model(copies), "Функция читает файл", 0, 0
    for outer, inner in enc.SINGLE:
        try:
            bad = phrase.encode(inner).decode(outer)
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
        if bad == phrase:
            continue
        total += 1
        garbled, text, whole = enc.restore(f"see {bad} here", m)
        if garbled and whole:
            assert text == f"see {phrase} here", (outer, inner)
            right += 1
    assert total > 10 and right >= 0.9 * total


@pytest.mark.parametrize("times", [1, 2, 3, 5, 7])
def test_garbled_again_and_again(times):
    bad = "Größe"
    for _ in range(times):
        bad = bad.encode("utf-8").decode("latin-1")
    assert enc.restore(f"see {bad} here", model(5)) == (True, "see Größe here", True)


def test_sound_text_stays():
    m = model(20)
    for t in [*SOUND, "plain", "'â€™'.encode('cp1252')", None, ""]:
        assert enc.restore(t, m) == (False, t, True)


def test_signs_do_not_hang_on_size():
    a, b = model(5), model(500)
    seen = [p for p in a.pair][:200] + [(0xFC, 0x0444), (0xC3, 0xBC), (0x0444, 0xE9)]
    assert all((a.improbable(*p) > 0) == (b.improbable(*p) > 0) for p in seen)
