"""Gaps of scripts without spaces, in words that the tests of sentences don't use."""

import pytest

from palimp.llm.sentences import block_starts, lattice_words
from palimp.llm.spaceless import DICTIONARY

# Sentences of one block each, and what stands between them.
BLOCKS = [
    (["「雨。」", "机の上に本を置いた。", "終わり。"], ""),  # no final particle, and an opening word that is in no list
    (["校长说：“下雨。”", "孩子跑回家。", "门关上了。"], ""),
    (["彼は「雨。」と言って帰った。", "とても寒い。", "ところが、犬は元気だ。"], ""),
    (["雨だ。と言って帰った。", "夜になった。"], ""),
    (["校长说“下雨。”的时候，孩子笑了。", "时间到了。"], ""),
    (["“下雨。”", "时间到了。"], ""),
    (["今日は寒いです", "しかし犬は元気です"], "\u3000"),
    (["今日は 寒いです。", "犬は元気です｡", "猫も元気です。"], ""),
    (["値は３．５である。", "次は４．２だ。"], ""),
    (["ខ្ញុំទៅផ្សារ។", "គាត់នៅផ្ទះ៕"], " "),
    (["ខ្ញុំទៅផ្សារ។", "គាត់នៅផ្ទះ។"], ""),
    (["ကျွန်တော်သွားသည်။", "သူနေသည်။"], ""),
    (["ฉันไปตลาดครับ", "เขาอยู่บ้าน"], " "),
    (["ฝนตกหนัก และ ลมแรง", "ดังนั้นเราจึงอยู่บ้าน"], " "),
    (["ຝົນຕົກ", "ດັ່ງນັ້ນພວກເຮົາຢູ່ບ້ານ"], " "),
]


@pytest.mark.parametrize("block, gap", BLOCKS)
def test_gaps(block, gap):
    want, at = [], 0
    for s in block:
        want.append(at)
        at += len(s) + len(gap)
    assert block_starts(gap.join(block)) == want


def test_words():
    assert lattice_words("时间到") == ["时间", "到"] and lattice_words("とても寒")[0] == "とても"
    assert not DICTIONARY & {"査読者", "温度", "粗い", "膜", "Ver", "样品", "审稿人", "版本"}
