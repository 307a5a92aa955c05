"""Problem 4: cutoffs chosen on one half of planted pairs and checked on the other; several labels at once."""

import random

import pytest

from seamline.llm import p4_pairs as p4

REQ = "request_id bigint, prompt string"
RESP = "response_id bigint, request_id bigint, content string, action_count int, proposal_summary string, source string"
PROMPTS = {
    "en": ["Please explain how the report reads the {} and what it does with an empty list.", "Why does the save step of {} fail when the folder is missing?", "Rename the helper in {} and tell me which callers change."],
    "de": ["Bitte erkläre, wie der Bericht die Datei {} liest und was er mit einer leeren Liste macht.", "Warum schlägt das Speichern in {} fehl, wenn der Ordner nicht da ist?"],
    "fr": ["Explique comment le rapport lit le fichier {} et ce qu’il fait avec une liste vide.", "Pourquoi la sauvegarde de {} échoue-t-elle quand le dossier est absent ?"],
    "zh": ["请说明报表如何读取{}以及名单为空时怎么处理。", "为什么在目录不存在时保存{}会失败?"],
}
GOOD = {
    "en": "The step in {} reads the rows first and sorts them by their score. When the list is empty it returns zero and writes no file, so the caller has to check that before it shows the table.",
    "de": "Der Schritt in {} liest zuerst die Zeilen und sortiert sie nach dem Wert. Wenn die Liste leer ist, gibt er null zurück und schreibt keine Datei, also muss der Aufrufer das vorher prüfen.",
    "fr": "L’étape dans {} lit d’abord les lignes et les trie par valeur. Quand la liste est vide, elle renvoie zéro et n’écrit pas de fichier, donc l’appelant doit le vérifier avant.",
    "zh": "{}里的这一步先读取所有记录,再按分数排序。名单为空时返回零,并且不写文件,所以调用方要先检查这一点,再显示表格。",
}
NO = {
    "en": ["I’m sorry, but I can’t help with that.", "I am unable to do this. Please ask your administrator."], "de": ["Dabei kann ich leider nicht helfen.", "Das darf ich nicht ausführen. Bitte wenden Sie sich an die Leitung."],
    "fr": ["Désolé, je ne peux pas répondre à cette demande.", "Je ne suis pas en mesure de le faire."], "zh": ["抱歉,我无法完成这个请求。", "对不起,我不能协助处理这件事。"],
}
VOID = ["", "   ", "N/A", "—", "无", "```\n```", "null", "..."]


def planted(n=1600, seed=11):
    """(prompt, answer, defects) of invented pairs, a fifth of them defective."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        lang = rng.choice(list(GOOD))
        name = f"`src/mod{rng.randrange(90)}/step_{k}.py`"
        prompt, answer = rng.choice(PROMPTS[lang]).format(name), GOOD[lang].format(name)
        defect = rng.choice(p4.DEFECTS) if rng.random() < 0.3 else None
        if defect == "empty_answer":
            answer = rng.choice(VOID)
        elif defect == "copies_question":
            answer = rng.choice([prompt, prompt.upper(), f"**{prompt}**", f"> {prompt}\n"])
        elif defect == "refusal":
            answer = rng.choice(NO[lang])
        elif defect == "truncated_answer":
            at = rng.randrange(len(answer) // 2, len(answer) - 6)
            answer = answer[:at].rstrip(" .,。,")
        elif defect == "wrong_language":
            answer = GOOD[rng.choice([x for x in GOOD if x != lang])].format(name)
        out.append((prompt, answer, {defect} - {None}))
    return out


@pytest.fixture(scope="module")
def judged(spark):
    rows = planted()
    req = spark.createDataFrame([(k, p) for k, (p, *_) in enumerate(rows)], REQ)
    resp = spark.createDataFrame([(k, k, a, 0, "", "x") for k, (_, a, _) in enumerate(rows)], RESP)
    got = {(r["response_id"], r["defect"]): r["posterior"] for r in p4.labels(req, resp, dict.fromkeys(p4.DEFECTS, 0.0)).collect()}
    return rows, got


def scores(rows, got, ids, defect, cutoff):
    flagged = {k for k in ids if got.get((k, defect), 0) > cutoff}
    true = {k for k in ids if defect in rows[k][2]}
    both = len(flagged & true)
    return both / max(1, len(true)), both / max(1, len(flagged))


def f1(recall, precision):
    return 2 * recall * precision / max(1e-9, recall + precision)


@pytest.mark.parametrize("defect", p4.DEFECTS)
def test_cutoff_is_chosen_on_one_half_and_holds_on_the_other(judged, defect):
    rows, got = judged
    chosen_on, held_out = range(0, len(rows), 2), range(1, len(rows), 2)
    grid = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]
    best = max(f1(*scores(rows, got, chosen_on, defect, c)) for c in grid)
    assert f1(*scores(rows, got, chosen_on, defect, p4.CUTOFFS[defect])) >= best - 0.005
    recall, precision = scores(rows, got, held_out, defect, p4.CUTOFFS[defect])
    assert recall >= 0.93 and precision >= 0.95, (recall, precision)


def test_one_answer_keeps_two_labels(spark):
    rows = planted(400, 3)
    double = [(PROMPTS["en"][0].format("`a.py`"), NO["de"][0]), (PROMPTS["fr"][1].format("`b.py`"), "I am sorry, but I cannot help with this. I am not able to do that")]
    pairs = [(p, a) for p, a, _ in rows] + double
    req = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(pairs)], REQ)
    resp = spark.createDataFrame([(k, k, a, 0, "", "x") for k, (_, a) in enumerate(pairs)], RESP)
    got = {}
    for r in p4.labels(req, resp).where(f"response_id >= {len(rows)}").collect():
        got.setdefault(r["response_id"] - len(rows), set()).add(r["defect"])
    assert got[0] == {"refusal", "wrong_language"} and got[1] >= {"refusal", "wrong_language"}


def test_short_prompts_can_be_copied(spark):
    assert p4._copies("Fix it", "fix it!") == (1, 1, 1, 1) and p4._copies("Fix it", "Done.")[0] == -1 and p4._copies("", "x") == (0, 0, 0, 0)


def test_languages_by_script_and_refusals_in_spanish():
    assert p4.languages("これは設定ファイルを読み込む処理です。")[1] == "ja" and p4.languages("Эта функция читает файл настроек.")[1] == "ru" and p4.languages("这个函数读取配置文件并保存。")[1] == "zh"
    assert p4._language("请说明这个函数如何读取配置文件。", "これは設定ファイルを読み込む処理です。")[0] == 1
    assert p4._refusal("Lo siento, no puedo realizar esta tarea.")[0] == 1 and p4._refusal("Infelizmente não posso fazer isso.")[0] == 1
