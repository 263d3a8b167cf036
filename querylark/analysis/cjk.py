"""Chinese, Japanese and Korean: every character is a term of its own, so a word is a phrase of its characters.

The fold tables are short, of common characters; whole ones from public data (Unihan, OpenCC) can be given as dictionaries."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_JAVA = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}])"
_PYTHON = re.compile("([\u1100-\u11ff\u3005-\u3007\u3040-\u30ff\u3130-\u318f\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua960-\ua97f\uac00-\ud7ff\uf900-\ufaff\uff66-\uff9f\uffa0-\uffdc\U00020000-\U0003ffff])")


def split_column(c: Column) -> Column:
    return F.regexp_replace(c, _JAVA, " $1 ")


def split(text: str) -> str:
    return _PYTHON.sub(r" \1 ", unicodedata.normalize("NFC", text))


def _pairs(text: str) -> dict[str, str]:
    return {p[0]: p[1] for p in text.split()}


SIMPLIFIED = _pairs(
    "學学 習习 國国 語语 會会 時时 來来 個个 們们 這这 說说 為为 對对 發发 經经 見见 長长 東东 車车 馬马 書书 電电 門门 問问 間间 聞闻 開开 關关 愛爱 氣气 漢汉 字字 萬万 與与 業业 樂乐 買买 賣卖 讀读 寫写 話话 請请 讓让 認认 識识 "
    "議议 論论 許许 設设 試试 詩诗 誰谁 調调 談谈 謝谢 證证 變变 貝贝 財财 責责 貨货 費费 貴贵 資资 質质 軍军 軟软 輕轻 輪轮 轉转 農农 進进 運运 過过 達达 遠远 還还 邊边 鄉乡 醫医 錢钱 鐵铁 銀银 錯错 陽阳 陰阴 階阶 際际 隊队 難难 雲云 "
    "靈灵 靜静 響响 頁页 頂顶 項项 順顺 須须 頭头 題题 顏颜 類类 風风 飛飞 飯饭 館馆 驗验 魚鱼 鳥鸟 麥麦 黃黄 點点 齊齐 龍龙 龜龟 歲岁 歷历 歸归 殺杀 滿满 灣湾 為为 無无 煙烟 熱热 爭争 爺爷 狀状 獨独 現现 環环 產产 畫画 當当 療疗 盡尽 監监 盤盘"
)
NEW_KANJI = _pairs("國国 學学 會会 體体 來来 變変 廣広 澤沢 齋斎 實実 寫写 氣気 發発 應応 淸清 眞真 圖図 靜静 黑黒 舊旧 當当 聲声 讀読 賣売 邊辺 關関 驛駅 鹽塩 龍竜 龜亀 櫻桜 濱浜 瀧滝 燒焼 獨独 榮栄 萬万 劍剣 圓円 壓圧 壽寿 島島 從従 德徳 惡悪")
HANGUL = _pairs("家가 族족 學학 國국 人인 大대 韓한 中중 山산 水수 火화 木목 金금 土토 日일 月월 年년 時시 分분 生생 先선 校교 東동 西서 南남 北북 父부 母모 兄형 弟제 長장 白백 靑청 民민 軍군 王왕 門문 萬만 寸촌 室실 敎교 外외 小소 一일 二이 三삼 四사 五오 六육 七칠 八팔 九구 十십")
