"""Spellings of one person or organisation."""

from __future__ import annotations

import pytest

from kithspark.llm.names import average_linkage, compare, edits, latin, most_edits, name_entities, near_keys, same_entity_pairs, tokens

COMMON = {"youth", "choir", "chess", "circle", "robert", "katherine", "svetlana", "alexander"}


def form(name):
    return [f"C:{t[2:]}" if t[:2] == "F:" and t[2:] in COMMON else t for t in tokens(name)]


def verdict(a, b):
    v, _, _ = compare(form(a), form(b))
    w, _, _ = compare(form(b), form(a))
    assert v == w
    return v


@pytest.mark.parametrize(
    "a, b, want",
    [
        ("Archiibald Preryonla", "Archibald Ivo Prerunola", "strong"),
        ("Nadílmark, Harriet", "Harriet Nadílmark", "strong"),
        ("NADÍLMARK Mikhail", "Mikhail Nadílmark", "strong"),
        ("Joerg Haber", "Jörg Haber", "strong"),
        ("Татьняа Осташкина", "Татьяна Осташкина", "strong"),
        ("Oksana Topolenko", "Оксана Тополенко", "strong"),
        ("JürgenNílagková", "Jürgen Nílagková", "strong"),
        ("Sebastian_Flónébsen", "Sebastian Flónébsen", "strong"),
        ("Grarely Youth Choir", "The Grarley Youth Choir (official)", "strong"),
        ("Youth Choir, Grarley", "Grarley Youth Choir", "strong"),
        ("Dadagero Youth Choir, Inc.", "Dadagero Youth Choir", "strong"),
        ("최가람 님", "최가람", "strong"),
        ("Misha Nafílmak", "Mikhail Nadílmark", "weak"),
        ("M Nadílmark", "Mikhail Nadílmark", "weak"),
        ("Robert M.", "Robert Ivo Märargrove", "weak"),
        ("Zébola CC", "Zébola Chess Circle", "weak"),
        ("Zébola C.C.", "Zébola Chess Circle", "weak"),
        ("Coach Svetlana", "Svetlana Sosetti", "weak"),
        ("Harriet Nadílmark", "Olumide Nadílmark", "no"),
        ("Josie Grílnier", "José Grílnier", "no"),
        ("Zébola Chess Circle", "Zébola Youth Choir", "no"),
        ("Nadílmark", "Harriet Nadílmark", "no"),
        ("Quentin Haderwick", "Isabella Quentin Haderwick", "no"),
    ],
)
def test_pairs(a, b, want):
    assert verdict(a, b) == want


def test_tokens_of_nobody_and_of_odd_texts():
    assert all(tokens(x) == [] for x in (None, "", "  ", "unknown", "No idea", "?", "123", "-", "N/A"))
    assert tokens("x" * 50_000)[0].startswith("F:") and tokens(",") == [] and latin("Ｂоb​") == "Bob"


def test_edits():
    assert [edits("abcd", x, 2) for x in ("abcd", "abdc", "abd", "xbcd", "xbcy", "zzzz")] == [0, 1, 1, 1, 2, 3]


def test_average_linkage_stops_at_the_mean():
    everyone = [True] * 4
    chain = {(0, 1): 0.9, (1, 2): 0.9, (2, 3): 0.9}
    assert average_linkage(everyone, chain, 0.5) == [0, 0, 2, 2]
    assert average_linkage(everyone, {(i, j): 0.6 for i in range(4) for j in range(i + 1, 4)}, 0.5) == [0] * 4
    # Two requests aren't compared, so they don't lower the mean.
    assert average_linkage([True, False, False], {(0, 1): 0.9, (0, 2): 0.9}, 0.5) == [0, 0, 0]


def test_frames(spark):
    rows = [
        (1, "person", 1, "Mikhail Nadílmark"), (1, "person", 2, "Harriet Nadílmark"), (1, "person", 3, "Mikhaill Nadílmark"), (1, "person", 4, "Valentina Sorel"),
        (1, "request", 1, "Misha Nadílmark"), (1, "request", 2, "H. Nadílmark"), (1, "request", 3, "Nadílmark"), (1, "request", 4, "Tina"), (1, "request", 5, "unknown"),
        (1, "request", 6, None), (1, "request", 7, "Mikhail Nadílmark"), (1, "request", 7, "Mikhail Nadílmark"), (1, "request", 8, "Boris Sorel"),
        (2, "person", 5, "Mikhail Nadílmark"), (2, "request", 9, "Misha"), (2, "person", 6, "Mikhail Orlov"), (None, "request", 10, "Misha Nadílmark"), (1, "person", None, "X Y"), (1, "request", 11, ""),
    ]
    df = spark.createDataFrame([(*r, 0, "f") for r in rows], "lib bigint, kind string, id bigint, name string, entity int, form string")
    got = {(r.id_a, r.kind_b, r.id_b) for r in same_entity_pairs(name_entities(df)).collect()}
    assert got == {(1, "person", 3), (1, "request", 1), (3, "request", 1), (3, "request", 7), (2, "request", 2), (4, "request", 4)}
    assert name_entities(df.limit(0)).count() == 0


def test_close_words_share_a_key():
    for word in ("abcd", "abcdef", "abcdefg", "abcdefghijklmnopqrstuvwx", "abcdefghijklmnopqrstuvwxyz0", "ab" * 3_000):
        swapped, shorter, longer = word[1] + word[0] + word[2:], word[:1] + word[2:], word[:2] + "qq" + word[2:]
        for other in (swapped, shorter, shorter[:-1], longer, longer[:-1] + "z"):
            if edits(word, other, 2) <= most_edits(max(len(word), len(other))):
                assert near_keys(word, True) & near_keys(other, False) and near_keys(other, True) & near_keys(word, False)


def test_typing_error_of_a_frequent_word_in_many_libraries(spark):
    # Anselmo is a name of its own; Anslem turns up in five of forty libraries only as an error of Anselm.
    rows = [(lib, "person", lib, f"Anselm Qu{chr(97 + lib % 26)}rtz{chr(97 + lib // 26)}") for lib in range(40)]
    rows += [(lib, "request", 100 + lib, rows[lib][3].replace("Anselm", "Anslem")) for lib in range(5)]
    rows += [(lib, "request", 200 + lib, rows[lib][3].replace("Anselm", "Anselmo")) for lib in range(10, 30)]
    got = {(r.id_a, r.id_b) for r in same_entity_pairs(name_entities(spark.createDataFrame(rows, "lib bigint, kind string, id bigint, name string"))).collect()}
    assert got == {(lib, 100 + lib) for lib in range(5)}


def test_vectors_have_length_one_and_rare_grams_weigh_more(spark):
    from kithspark.llm.names import gram_vectors

    rows = [(i, 1, True, f) for i, f in enumerate(["F:anna F:berg", "F:anna F:sorel", "F:anna F:xu", "I:a"])]
    got = {}
    for r in gram_vectors(spark.createDataFrame(rows, "f bigint, lib bigint, person boolean, form string")).collect():
        got.setdefault(r.f, {})[r.gram] = r.w
    assert set(got) == {0, 1, 2, 3} and all(abs(sum(w * w for w in v.values()) - 1) < 1e-9 for v in got.values())
    common = set(got[0]) & set(got[1])
    assert common and max(got[0][g] for g in common) < min(w for g, w in got[0].items() if g not in common)
