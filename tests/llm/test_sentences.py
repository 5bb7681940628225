import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stellate.llm import sentences

CASES = [
    ("Dr. Smith measured 3.5 ms. It works.", ["Dr. Smith measured 3.5 ms.", "It works."]),
    ("Use e.g. this one. See Fig. 3 and No. 4. Done!", ["Use e.g. this one.", "See Fig. 3 and No. 4.", "Done!"]),
    ("They met at 5 p.m. on Monday. J. R. Hall left at 6 a.m. The door closed.", ["They met at 5 p.m. on Monday.", "J. R. Hall left at 6 a.m.", "The door closed."]),
    ("The U.S. plan failed. We sell pens, etc. Then we left.", ["The U.S. plan failed.", "We sell pens, etc.", "Then we left."]),
    ('He wrote: "Do not go. It rains." Then he left.', ['He wrote: "Do not go. It rains."', "Then he left."]),
    ('"Is it ready?" asked Anna. "It is locked. Wait." was the answer.', ['"Is it ready?" asked Anna.', '"It is locked. Wait." was the answer.']),
    ("The run (it was no. 3. Really!) ended well. Fine.", ["The run (it was no. 3. Really!) ended well.", "Fine."]),
    ("Wait for it ... then press Enter. It was slow… but correct. OK.", ["Wait for it ... then press Enter.", "It was slow… but correct.", "OK."]),
    ("Open notes.md now. wal_keep is 5. e2e tests passed.", ["Open notes.md now.", "wal_keep is 5.", "e2e tests passed."]),
    ("It runs fast.The next one too!Good.", ["It runs fast.", "The next one too!", "Good."]),
    ("Der 2. Knoten läuft seit dem 12.04. ohne Pause. Am 3. Mai, z. B. früh, d. h. um 5 Uhr. Gut.", ["Der 2. Knoten läuft seit dem 12.04. ohne Pause.", "Am 3. Mai, z. B. früh, d. h. um 5 Uhr.", "Gut."]),
    ("„Ist es fertig?“, fragte Eva. Die Meldung: „Gesperrt. Warten.“ Ende.", ["„Ist es fertig?“, fragte Eva.", "Die Meldung: „Gesperrt. Warten.“", "Ende."]),
    ("M. Roux a dit : « Non. Jamais. » « Prêt ? » demanda Luc.", ["M. Roux a dit : « Non. Jamais. »", "« Prêt ? » demanda Luc."]),
    ("EE. UU. tiene tres. ¿Y si falla? ¡No! Véase la pág. 8.", ["EE. UU. tiene tres.", "¿Y si falla?", "¡No!", "Véase la pág. 8."]),
    ("Это верно, т. е. да. Копии и т. д. Г-н Иванов ушёл. См. рис. 5.", ["Это верно, т. е. да.", "Копии и т. д.", "Г-н Иванов ушёл.", "См. рис. 5."]),
    ("“准备好了吗？”用户问道。他说：“锁住了。请稍后。”我们在等……向量没有；稠密有。", ["“准备好了吗？”用户问道。", "他说：“锁住了。请稍后。”", "我们在等……", "向量没有；稠密有。"]),
    ("（注意：可能落后。）检查全部。", ["（注意：可能落后。）", "检查全部。"]),
    ("「準備は？」と聞いた。画面に「ロック中。お待ちを。」と出た。", ["「準備は？」と聞いた。", "画面に「ロック中。お待ちを。」と出た。"]),
    ("“됐나요?”라고 물었다. 왜 느린가요? 재현율은 0.5였다.", ["“됐나요?”라고 물었다.", "왜 느린가요?", "재현율은 0.5였다."]),
    ("डॉ. राम ने देखा। उसने कहा, “बंद है। रुकिए।” खोज धीमी है?", ["डॉ. राम ने देखा।", "उसने कहा, “बंद है। रुकिए।”", "खोज धीमी है?"]),
    ("قال د. سامي إنها متأخرة. لماذا البحث بطيء؟ تم.", ["قال د. سامي إنها متأخرة.", "لماذا البحث بطيء؟", "تم."]),
    ("Γιατί αργεί; Οι μικρές, π.χ. αυτές, μετρούν.", ["Γιατί αργεί;", "Οι μικρές, π.χ. αυτές, μετρούν."]),
    ("ค่า wal_keep ไม่ต้องเปลี่ยน เราจะลองใหม่ ตัวกรองเหลือ 31 จุด ดัชนีใหม่", ["ค่า wal_keep ไม่ต้องเปลี่ยน", "เราจะลองใหม่", "ตัวกรองเหลือ 31 จุด", "ดัชนีใหม่"]),
    ("# 1.5 Heads. Up\n- wait 5 min. or so\n- stop. Then wait.\n1. one\n2. two\n```\na. B.\n\nc\n```\ntext\nmore. End", ["# 1.5 Heads. Up", "- wait 5 min. or so", "- stop.", "Then wait.", "1. one", "2. two", "```\na. B.\n\nc\n```", "text\nmore.", "End"]),
    ("bot: Ready. user: no\r\n \r\nNext one", ["bot: Ready.", "user: no", "Next one"]),
    ("（可能。）Est. cost: 5. It is fast.J. R. Hall left.", ["（可能。）", "Est. cost: 5.", "It is fast.", "J. R. Hall left."]),
    ("", []), (" \n\t", []), ("...", ["..."]), ("(a [b “c", ["(a [b “c"]),
]


@pytest.mark.parametrize("text,expected", CASES)
def test_cases(text, expected):
    assert [text[a:b] for a, b in sentences.spans(text)] == expected


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB c.!?\n\r-#`\"“”()[]1。？「」ก ข;…'", max_size=200))
def test_everything_is_in_one_sentence(text):
    at = 0
    for a, b in sentences.spans(text):
        assert at <= a < b and not text[at:a].strip() and not text[a].isspace() and not text[b - 1].isspace()
        at = b
    assert not text[at:].strip()


def test_long_texts_take_near_linear_time():
    for text in ("Word e.g. No. word. " * 20_000, "(" * 50_000, "a" * 500_000, '"x. ' * 20_000, "etc. U.S. A. " * 20_000):
        found = sentences.spans(text)
        assert found[0][0] == 0 and found[-1][1] == len(text.rstrip())


def test_table(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "A one. B two.", 5), (3, "A one. B two.", 5), (None, "x", 5)], "doc_id long, text string, start_char long")
    assert sorted(map(tuple, sentences.sentences(docs).collect()), key=str) == sorted([(3, 0, 6), (3, 7, 13)] * 2 + [(None, 0, 1)], key=str)
    assert sentences.sentences(docs.limit(0)).count() == 0
