"""Character folding shared by the operators on text."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

#: Common characters in the traditional style and, at the same place, in the simplified one.
TRADITIONAL = (
    "隊來會團場與說頭溫樓為過對樂記遠時進圖燈車麥庫瀾羅鈞從寫嶺鏡寧鎮萬薩風瑪舊誰貝發開葉經這書雲崗錢魯鉤長還宮蘭鈴見喬諾龍達勞蓮給門澤馬"
    "贊請榮寬鵑廣鏈倫傑賓鍋華動輝現鐵聲節員島傳飛讓總鑰銀歸倉銅盤鍵話級歷個魚語觀邊補們裡東學國問題應點關於種樣實變氣聽讀買賣號張線紅綠黃藍"
)
SIMPLIFIED = (
    "队来会团场与说头温楼为过对乐记远时进图灯车麦库澜罗钧从写岭镜宁镇万萨风玛旧谁贝发开叶经这书云岗钱鲁钩长还宫兰铃见乔诺龙达劳莲给门泽马"
    "赞请荣宽鹃广链伦杰宾锅华动辉现铁声节员岛传飞让总钥银归仓铜盘键话级历个鱼语观边补们里东学国问题应点关于种样实变气听读买卖号张线红绿黄蓝"
)
TO_SIMPLIFIED = str.maketrans(TRADITIONAL, SIMPLIFIED)

PLANE = 1 << 16


def codes(text: str) -> np.ndarray:
    """Code points as numbers."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def is_cjk(code: int) -> bool:
    return 0x3400 <= code <= 0x9FFF or 0xF900 <= code <= 0xFAFF or 0x3040 <= code <= 0x30FF or 0xAC00 <= code <= 0xD7A3


@lru_cache(maxsize=1)
def signal() -> tuple[np.ndarray, np.ndarray]:
    """For each character of the basic plane: its folded form (0 if it is neither letter nor digit) and whether it is CJK.

    Folded are case, width, accents of Latin letters and the traditional style.
    """
    folded, cjk = np.zeros(PLANE, np.uint32), np.zeros(PLANE, bool)
    for c in range(PLANE):
        ch = chr(c)
        if 0xD800 <= c < 0xE000 or unicodedata.category(ch)[0] not in "LN":
            continue
        base = unicodedata.normalize("NFKD", ch)[:1].lower()[:1].translate(TO_SIMPLIFIED)
        if base:
            folded[c] = ord(base) if ord(base) < PLANE else 0
            cjk[c] = is_cjk(c)
    return folded, cjk
