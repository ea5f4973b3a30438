"""Encodings by samples: the text is right if it decodes to what was encoded."""

import pytest

from tessera.sources import encodings

SAMPLES = {
    "fr": "# réglages du système\nL'été dernier, la forêt était très sèche ; où êtes-vous allés, à la plage ou à l'école ? Ça va, merci.",
    "de": "Über die Brücke fährt täglich ein grüner Zug nach Köln; die Straße ist für Fußgänger gesperrt. Größe: schön.",
    "es": "El niño comió una manzana pequeña mañana por la tarde; ¿dónde está el árbol más alto del jardín? Sí, señor.",
    "pl": "Zażółć gęślą jaźń; wszystkie łodzie płyną wzdłuż brzegów rzeki, a dzieci śpią już spokojnie w swoich łóżkach.",
    "cs": "Příliš žluťoučký kůň úpěl ďábelské ódy; děti běžely přes řeku a křičely, že už přišel večer a světla svítí.",
    "ru": "Функция возвращает имя пользователя, если запись найдена. Иначе она сообщает об ошибке и пишет строку в журнал.",
    "uk": "Програма читає файл і записує результат до таблиці, а потім повідомляє користувача про стан роботи системи.",
    "el": "Η συνάρτηση επιστρέφει το όνομα του χρήστη αν υπάρχει η εγγραφή· αλλιώς γράφει ένα μήνυμα στο αρχείο.",
    "ja": "この関数はユーザーの名前を返します。見つからないときはエラーを書いて、ログに残します。テストも追加しました。",
    "zh": "这个函数返回用户的名字。如果没有找到记录，就写入日志并且报告错误。我们还增加了一些测试，请大家查看。",
    "tw": "這個函式會傳回使用者的名稱。如果找不到資料，就寫入記錄並且回報錯誤。我們也增加了一些測試，請大家查看。",
    "ko": "이 함수는 사용자의 이름을 돌려줍니다. 기록을 찾지 못하면 오류를 쓰고 로그에 남깁니다. 테스트도 추가했습니다.",
    "en": "def f(x):\n    return x  # plain\n",
}
CODECS = {
    "fr": ["cp1252", "latin-1"], "de": ["cp1252", "latin-1"], "es": ["cp1252", "latin-1"], "pl": ["cp1250"], "cs": ["cp1250"], "ru": ["cp1251", "koi8_r", "iso8859_5"], "uk": ["cp1251"],
    "el": ["cp1253"], "ja": ["cp932", "euc_jp", "iso2022_jp"], "zh": ["gb18030", "gbk"], "tw": ["big5"], "ko": ["euc_kr"], "en": ["ascii"],
}
EVERYWHERE = ["utf-8", "utf-8-sig", "utf-16", "utf-16-le", "utf-16-be", "utf-32"]


def cases():
    for name, text in SAMPLES.items():
        for codec in CODECS[name] + EVERYWHERE:
            half = len(text) // 2
            for piece in (text, text[:half], text[half:], f"x = 1  # {text}\ny = 2\n" * 3):
                try:
                    yield name, codec, piece, piece.encode(codec)
                except UnicodeEncodeError:
                    continue


def test_samples():
    every = list(cases())
    wrong = [(n, c, encodings.detect(d)) for n, c, t, d in every if encodings.decode(d).lstrip("﻿") != t]
    assert len(every) > 300 and len(wrong) <= 0.05 * len(every), wrong


@pytest.mark.parametrize("data,want", [(b"", "utf-8"), (b"abc\n", "utf-8"), (b"\xef\xbb\xbfa", "utf-8-sig"), (b"\xff\xfea\x00", "utf-16"), ("é".encode("latin-1") * 3, "cp1252"), (b"\x80\x81\xff\x00\x05", "latin-1")])
def test_small_and_odd(data, want):
    assert encodings.detect(data) == want and isinstance(encodings.decode(data), str)


@pytest.mark.parametrize("text", ["ring \x07 the bell, é", "a nul\x00 in a text of some length, and another\x00 one", "\x7fdeleted\x7f", "aaaaaa\x07b", "\x01\x02ab"])
def test_stray_control_characters_leave_utf8(text):
    assert encodings.detect(text.encode()) == "utf-8" and encodings.decode(text.encode()) == text


def test_any_bytes_have_a_text():
    for i in range(256):
        assert isinstance(encodings.decode(bytes([i, 255 - i, i ^ 90, 200, i])), str)
