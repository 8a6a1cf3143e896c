import hashlib
import os
import random

import pytest

from intakeflow.sources import charset
from intakeflow.sources.files import detect_charsets, fingerprints, sniff_charset

TEXTS = {
    "gb18030": "编号,姓名,地址,备注\n1,王小明,北京市海淀区中关村大街,订单已经完成并且发货\n2,李丽,上海市浦东新区,客户要求退款处理\n",
    "big5": "編號,姓名,地址,備註\n1,王小明,臺北市信義區忠孝東路,訂單已經完成並且出貨\n2,李麗,高雄市前鎮區,客戶要求退款處理\n",
    "shift_jis": "番号,氏名,住所\n1,山田太郎,東京都千代田区にあります,カタカナとひらがなのテスト\n2,鈴木花子,大阪府,注文はまだ届いていません\n",
    "euc_jp": "番号,氏名,住所\n1,山田太郎,東京都千代田区にあります,カタカナとひらがなのテスト\n2,鈴木花子,大阪府,注文はまだ届いていません\n",
    "euc_kr": "번호,이름,주소\n1,홍길동,서울특별시 강남구 테헤란로,주문이 완료되었습니다\n2,김영희,부산광역시,환불을 요청했습니다\n",
    "cp1251": "номер,имя,адрес\n1,Иван Петров,Москва Тверская улица,заказ выполнен\n2,Анна,Санкт-Петербург,клиент просит вернуть деньги\n",
    "koi8_r": "номер,имя,адрес\n1,Иван Петров,Москва Тверская улица,заказ выполнен\n2,Анна,Санкт-Петербург,клиент просит вернуть деньги\n",
    "latin-1": "numéro,prénom,adresse\n1,François,rue de la Liberté à Besançon,commande livrée\n2,Jürgen,Köln Straße,größere Änderung\n",
    "utf-8": "编号,имя,prénom\n1,山田太郎,홍길동\n",
}


@pytest.mark.parametrize("name", TEXTS)
def test_charsets_of_texts(name):
    data = TEXTS[name].encode(name)
    assert charset.guess([data], True)[0] == name and charset.guess([data], True)[1] >= charset.LEAST
    assert sniff_charset(data) == name
    lines = TEXTS[name].splitlines(keepends=True)
    r = random.Random(5)
    # a long file: cut samples, and one whose first bytes beyond ASCII come late, among numbers
    long = "".join(lines[r.randrange(1, len(lines))] for _ in range(6000)).encode(name)
    late = b"id,value\n" + b"1,2.5\n" * 40_000 + "".join(lines[1:]).encode(name) + b"7,1\n" * 9000
    for shift in range(4):
        assert sniff_charset(b"#" * shift + b"\n" + long) == name
    assert sniff_charset(late) == name


def test_marks_ascii_and_noise():
    assert sniff_charset(b"") == "utf-8" and sniff_charset(b"plain,text\n") == "utf-8"
    assert sniff_charset("\ufeffid".encode("utf-16")) == "utf-16" and sniff_charset("\ufeffé".encode()) == "utf-8-sig"
    assert sniff_charset("prix,15 €\nnuméro,“vrai”\n".encode("cp1252")) == "cp1252"
    noise = bytes(random.Random(1).choices([*range(0x80, 0xa0), 0xff, 10], k=5000))
    assert charset.guess([noise])[1] < charset.LEAST and sniff_charset(noise) == "utf-8"


def test_only_ranges_of_large_files_are_read(spark, tmp_path):
    """A sparse file of 3 GiB, beyond what one row can hold."""
    big, size = tmp_path / "a big+one%.csv", 3 << 30
    head, tail = "编号,姓名\n王小明,订单已经完成\n".encode("gbk") * 300, b"end" * 2000
    with open(big, "wb") as f:
        f.write(head)
        f.seek(size - len(tail))
        f.write(tail)
    (tmp_path / "ru.csv").write_bytes(TEXTS["cp1251"].encode("cp1251"))
    got = {os.path.basename(r.path): (r.file_size, r.file_hash) for r in fingerprints(spark, str(tmp_path)).collect()}
    want = hashlib.md5(head[:4096] + tail[-4096:] + str(size).encode()).hexdigest()[:16]
    assert got["a big+one%.csv"] == (size, want)
    found = {os.path.basename(r.path): r.charset for r in detect_charsets(spark, f"file:{tmp_path}").collect()}
    assert found == {"a big+one%.csv": "gb18030", "ru.csv": "cp1251"}
    assert {r.charset for r in detect_charsets(spark, str(tmp_path), hint="big5").collect()} == {"big5"}
