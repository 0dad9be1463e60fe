"""Words of scripts without spaces, by the part they play at a gap between sentences."""

from __future__ import annotations

# Words that report what stands before them, also after a terminator without a quotation.
QUOTING = frozenset(
    """という といった といい といって といえる とする とした とされる とされた として との って と言 と述べ と書 と記 と考え と思 と答え と報告 と報じ と呼 と主張 と結論 と説明 と指摘 と語 と話 と伝え と聞 と叫 と尋ね
    と訊 と問 と命じ と感じ と判断 と認め と評 と訳 と続け と返 と告げ と読""".split()
)
# Particles and copulas that go on after a quoted sentence.
PARTICLES = QUOTING | frozenset("と は が を に の も で や へ から まで より など だ です である である。 だった でした であった という など なら ならば のみ だけ さえ にて による によると について に対し とも とか".split())
# Chinese words that go on after a quoted sentence.
CONTINUING = frozenset("但 但是 而 而且 并 并且 然而 不过 的 地 得 和 与 及 以及 这 等 之 以 所 一 一词 一语 一句 一类 这句话 这样 这种 这一 说 道 写道 指出 后 时 为 是 在 来 时说 字样 等等 等词 之类 之后 之前 之时".split())
# Words that a sentence ends with, and those of them that end nothing else.
FINALS = frozenset("た る だ です ます い う く す つ ぬ ふ む ろ か よ ね ぞ な 了 吗 呢 吧 啊 的 着 过".split())
ENDING = frozenset(
    """です ます ました でした ません ませんでした でしょう ましょう ください ですか ますか ましたか ですね ますね ですよ ますよ 吗 呢 吧 啊 呀 嘛
    ครับ ค่ะ คะ นะครับ นะคะ จ้ะ จ้า หรือไม่ หรือเปล่า ຄັບ ເດີ້""".split()
)
# Words that open a sentence and nothing else, so that they do where no terminator stands before them.
CONNECTIVES = frozenset(
    """また しかし しかしながら そこで さらに 次に 例えば たとえば ただし したがって 従って よって なお ところが ところで とはいえ それでも それから そして すると つまり すなわち なぜなら 一方 一方で 他方 逆に 要するに だから ですから
    だが けれども でも では それでは 最後に 最初に まず 第一に 第二に とりわけ 特に ちなみに もっとも ゆえに 加えて 同様に 結局 このため そのため このように その結果 というのも というのは といっても とすると とすれば ともかく とにかく
    因此 所以 此外 另外 同时 首先 其次 再次 最后 总之 例如 比如 然后 接着 于是 因而 从而 另一方面 一方面 与此同时 综上所述 由此可见 换言之 换句话说 尽管如此 虽然 如果 由于 因为 为了 当然 其实 事实上 实际上 一般来说 值得注意的是 不仅如此 除此之外 相反 同样 反之 具体来说 后来
    ดังนั้น อย่างไรก็ตาม อย่างไรก็ดี แต่อย่างไรก็ตาม นอกจากนี้ นอกจากนั้น ทั้งนี้ เพราะฉะนั้น เพราะเหตุนี้ ด้วยเหตุนี้ ต่อมา จากนั้น หลังจากนั้น ในที่สุด สุดท้าย ประการแรก ประการที่สอง กล่าวคือ ตัวอย่างเช่น อนึ่ง โดยสรุป ในทางกลับกัน ขณะเดียวกัน
    ດັ່ງນັ້ນ ນອກຈາກນັ້ນ ນອກຈາກນີ້ ຫຼັງຈາກນັ້ນ ຢ່າງໃດກໍຕາມ ແຕ່ຢ່າງໃດກໍຕາມ ដូច្នេះ លើសពីនេះ បន្ទាប់មក ទោះជាយ៉ាងណា ទោះជាយ៉ាងណាក៏ដោយ ထို့ကြောင့် သို့သော် ထို့အပြင် ထို့နောက်""".split()
)
# Words that open a sentence after a terminator.
OPENERS = CONNECTIVES | frozenset(
    """この その あの どの これ それ あれ これら それら ここで ここ そこ ここに 図 表 式 全 各 本 我々 我々は 私 私は 私たち 彼 彼は 彼女 彼女は 誰 何 なぜ どう もし もちろん おそらく たぶん やはり 実際 実は 今 今日 昨日 当時 はじめに はじめ はい いいえ いま
    とても とくに とき ときに ときどき ところ とうとう ともに となり にも のち のちに もう もっと ものの やがて やや やっと より多く からだ まだ まったく までに がん がら でき できる できれば できた でんき へや やま のり なぜか
    我们 我 他 她 它 他们 她们 它们 你 你们 该 此 本 如 图 表 全部 所有 每 各 某 有 没有 有些 许多 大多数 当 在此 在这里 在此基础上 以上 以下 以往 一般 一些 一旦 一切 一个 一种 所谓 所用 所得 为此 为什么 时间 时而 来自 之所以 等到 等待 后者 后面 后续 的确 得到 得益于 和平 与其 及时 地面 地球 地方 道路 说明 是否
    这里 这些 这个 这表明 这说明 这时 并非 并未 而今""".split()
)
# Thai, Lao and Khmer words that go on after a blank.
JOINING = frozenset("และ หรือ ที่ ซึ่ง ว่า แต่ จึง ก็ เพราะ โดย ของ ใน แล้ว ແລະ ຫຼື ທີ່ ວ່າ និង ឬ ដែល ថា".split())
# Common words that are cut as one and decide nothing.
COMMON = frozenset(
    """こと もの ため よう とおり ほか うち なか まえ あと ない なる なり なった なく する した して いる いた ある あった ている ていた された される られる れる また は が を に の も 研究 実験 結果 方法 問題 記録 測定 分析 時間 場合 必要 可能 重要 関係 社会 世界 日本 日本語 言葉
    人間 自分 先生 学生 学校 会社 電話 電気 仕事 生活 意味 理由 目的 部分 全体 一部 一つ 一人 二つ 以上 以下 以外 以前 以後 今後 最近 現在 将来 過去 東京 中国
    研究 实验 结果 方法 问题 记录 测量 分析 时候 情况 必要 可能 重要 关系 社会 世界 中国 语言 人们 自己 老师 学生 学校 公司 电话 工作 生活 意思 理由 目的 部分 整体 之间 其中 可以 不能 已经 还是 就是 也是 不是 但愿 而言 所在 并不 并没有 得出 目的地 的话 实在 现在 存在 所致 发现 表明 认为 需要 使用 进行 通过 根据 关于 对于 完整 停止 消失 着手 着重 过程 过去 过于 了解 为止 成为 作为 因为 来源 原来 未来 以来 是非 等级 等于 平等 和谐 及格 与会 说法 小说 知道 报道 渠道""".split()
)
DICTIONARY = PARTICLES | CONTINUING | FINALS | ENDING | OPENERS | JOINING | COMMON
