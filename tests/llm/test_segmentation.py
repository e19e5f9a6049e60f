import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm.segmentation import sentences
from skein.llm.sentences import sentence_starts, split_sentences


def cut(text, hint=None):
    return [text[a:b] for a, b in sentences(text, hint)]


CASES = {
    "en": ["Dr. Castrell tuned it at 9:30 a.m. in Lindesk.", "J. R. Oduvel et al. measured 4.2% fewer files.", "It was moved to the U.S.", "The U.S. mirror holds No. 55 of the series.", '"Does it drop a page?" asked the editor.', "rankd is the default on most nodes.", "It slowed ... and then it recovered.", "Why does it drift?!", "'It is old,' said Prof. Ylenko, 'and nothing more.'", "(The index was merged in 2007.)", "Logs, etc.", "Stop!"],
    "de": ["Im 3. Quartal 2004 fiel der Wert auf 12,67.", "Am 28. Mai wurde es z. B. um 25,72 % kleiner.", "Die Fa. Silmon liefert ca. 1.476 Blätter pro Std. an das Archiv.", "„Ist das alles?“, fragte die Leiterin.", "Laut Dr. Silmon reicht das, d. h. es bleibt stabil."],
    "fr": ["M. Halgi a relu le vecteur, p. ex. les 89 premières pages.", "« Est-ce fini ? » demanda le chef.", "Faut-il garder la mémoire ?!", "La moyenne passe à 27,59 % (cf. fig. 178) en 2022."],
    "es": ["«¿Es todo?», preguntó la Dra. Lumvis.", "En EE. UU. se usa la lista desde 2003.", "¿Por qué falla la consulta?!", "Véase la fig. 44 y el cap. 294."],
    "ru": ["Фирма Silgiq хранит ок. 200 тыс. страниц и т. д. в одном месте.", "«Это всё?» — спросил д-р Kelbelka.", "В 2012 г. вектор стал меньше, т. е. почти вдвое.", "Проф. Halkaq и др. проверили порядок дважды."],
    "hi": ["“क्या यह पूरा है?” संपादक ने पूछा।", "डॉ. Kelzudor ने 2016 में जाँच की।", "चित्र क्र. 134 देखें।"],
    "ar": ["«هل انتهى العمل؟» سأل المحرر.", "انظر ص. 128 وما بعدها.", "راجع د. Zanmelune نتائج الفهرس."],
}
SOLID = {
    "zh": ["他说：“索引很慢。我们再试一次。”", "“真的吗？”审稿人问道。", "分数从33.21升到1.7。", "公司换了索引……后来又换了回来。", "真好！"],
    "ja": ["担当者は「一覧が遅い。もう一度試そう。」と述べた。", "「本当ですか？」と編集者が尋ねた。", "社は変更した…が、すぐに戻した。", "v3.0.5は対応していますか？"],
}


@pytest.mark.parametrize("lang", sorted(CASES))
def test_spaced_scripts(lang):
    for order in (CASES[lang], CASES[lang][::-1]):
        assert cut(" ".join(order), lang) == order
        assert cut("\n\n".join(order)) == order


@pytest.mark.parametrize("lang", sorted(SOLID))
def test_unspaced_scripts(lang):
    for order in (SOLID[lang], SOLID[lang][::-1]):
        assert cut("".join(order), None) == order


def test_thai():
    parts = ["ใคร ๆ ก็ใช้รายการได้", "ในกล่องมีคำอยู่ 39 คำ", "ดร.Lumkas ตรวจรายการเมื่อปี 2018", "แล้วเราก็กลับบ้าน"]
    assert cut(" ".join(parts), "th") == parts


def test_lines():
    assert cut("## Title\nA sentence that\nwraps here. Next.\n- item one.\n2. item two\nLast.") == ["## Title", "A sentence that\nwraps here.", "Next.", "- item one.", "2. item two", "Last."]
    assert cut("Norvik 42\n\nIt is. It\tis. So") == ["Norvik 42", "It is.", "It\tis.", "So"]
    assert cut("He left.The cat stayed. See config.yaml now.") == ["He left.", "The cat stayed.", "See config.yaml now."]


@pytest.mark.parametrize("text", [None, "", "  \n\t", "　"])
def test_nothing(text):
    assert sentences(text) == []


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aB1 .!?\"'“”«»「」()。\n-*…กข é"), max_size=80))
def test_spans_cover_everything_but_space(text):
    spans, at = sentences(text), 0
    for a, b in spans:
        assert at <= a < b and not text[at:a].strip() and not text[a].isspace() and not text[b - 1].isspace()
        at = b
    assert not text[at:].strip()


def test_long_text():
    assert len(sentences("It is so. " * 20_000)) == 20_000


def test_frames(spark):
    df = spark.createDataFrame([(1, 0, "A b. C d.", "en", 9), (1, 0, "A b. C d.", "en", 9), (1, 1, None, "en", 1), (2, 0, " ", None, 1), (None, 0, "x", "??", 1)], "doc_id long, chunk_id int, text string, language string, sent_no int")
    rows = sorted((r.doc_id or 0, r.chunk_id, r.sent_no, r.sentence) for r in split_sentences(df, ["doc_id", "chunk_id"], "text", "language").collect())
    assert rows == [(0, 0, 0, "x"), (1, 0, 0, "A b."), (1, 0, 1, "C d.")]
    assert sentence_starts(df, ["doc_id", "chunk_id"], "text", "language").count() == 3
    assert sentence_starts(df.where("doc_id = 7"), ["doc_id", "chunk_id"], "text").count() == 0


@pytest.mark.parametrize("n", [1, 31, 32, 100, 5000])
@pytest.mark.parametrize("left, right, parts", [("It was 5 p.m.", "and late.", 1), ("We use foo.", "bar is late.", 2), ("Ask Dr.", "Silva about it.", 1), ("It ends.", "It begins.", 2)])
def test_runs_of_white_space_change_nothing(n, left, right, parts):
    assert len(cut(left + " " * n + right)) == parts
    assert len(cut(left + " " * (n // 2) + "\n" + " " * (n // 2) + right)) == parts


@pytest.mark.parametrize("n", [1, 63, 64, 65, 1000])
def test_any_number_of_open_marks_may_lie_in_a_quotation(n):
    text = "He said: “one. " + "( " * n + " Two. Three.” And left."
    assert cut(text) == [text[: text.index(" And")], "And left."]


def test_long_marker_lines():
    text = "-" + " " * 40 + "an item. With two parts"
    assert cut(text) == [text]
    text = "First line ends." + " " * 300 + "\n" + "- an item\n- another"
    assert cut(text)[1:] == ["- an item", "- another"]
