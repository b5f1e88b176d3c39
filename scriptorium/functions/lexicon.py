"""Closed vocabularies of the Chinese profile. Operators take them as parameters; other languages pass their own."""

# Word lists, keyword groups and role names, in their given order.

#: Removed from questions before terms are taken.
QUERY_NOISE = ['是谁', '什么', '什么人', '什么时候', '哪年', '哪一年', '哪里', '何地', '哪些', '几个', '是不是', '故事', '讲讲', '生平', '经历', '事迹', '如何', '怎么看', '怎么说', '评价', '评论', '有哪些', '哪些故事',
 '有哪些故事', '谁杀了', '杀了', '杀死', '任命', '拥立', '攻打', '伐', '怎么']

#: Added as tokens where a text without blanks contains them.
KEYWORDS = ['领导', '老板', '同事', '下属', '合伙', '站队', '信任', '猜忌', '授权', '冲突', '绕过', '压力', '委屈', '团队', '内斗', '表态', '去留', '制衡', '联盟', '用人', '沟通', '谗言', '谣言', '诬陷', '构陷',
 '离间', '中伤', '告密', '外戚', '宠臣', '宦官', '后宫', '反间', '功高震主', '排挤', '边缘化', '打压', '报复', '嫉妒', '偏信', '背叛', '反目', '负义', '翻脸', '眼红']

CASE_QUERY_NOISE = ['怎么办', '如何处理', '怎么处理', '如何管理', '怎么管理', '如何应对', '怎么应对', '有关', '相关', '案例', '史例', '问题']

LOOKUP_NOISE = ['司马光怎么看', '司马光如何评价', '司马光评价', '司马光评论', '司马光怎么说', '是谁', '谁杀了', '杀了', '杀死', '有哪些故事', '故事', '讲讲', '生平', '经历', '如何评价', '怎么看', '怎么说', '评价', '评论', '有哪些',
 '哪些', '什么']

#: Scene and its keywords.
SCENES = {'向上管理': ['领导', '老板', '上级', '汇报', '越级', '直属'],
 '横向协作': ['同事', '跨部门', '协作', '抢功', '配合'],
 '团队冲突': ['团队', '下属', '核心成员', '互相', '冲突', '看不顺眼'],
 '用人与授权': ['授权', '用人', '骨干', '责任', '岗位'],
 '信任与猜忌': ['不信任', '猜忌', '怀疑', '试探', '边缘化'],
 '谗言与谣言': ['谗言', '谣言', '造谣', '诬陷', '中伤', '背后说', '告状', '诋毁', '诽谤', '针对', '刁难', '挤兑'],
 '嫉妒与背叛': ['嫉妒', '眼红', '见不得', '过得好', '好友', '发小', '同村', '兄弟反目', '背叛', '翻脸', '背后捅刀'],
 '站队与表态': ['站队', '表态', '沉默', '内斗', '高层'],
 '合伙与控制权': ['合伙', '联合创始人', '控制权', '绕过我'],
 '去留与进退': ['离职', '留下', '去留', '进退', '跳槽'],
 '组织变革': ['变革', '调整', '改革', '重组'],
 '情绪恢复': ['累', '疲惫', '委屈', '焦虑', '失落', '迷茫']}

#: Conflicts that a scene implies.
CONFLICTS = {'向上管理': ['直接上级信任不足', '更高层关注带来越级嫌疑', '信息透明与自我保护之间的张力'],
 '横向协作': ['功劳与责任边界不清', '协作依赖与利益竞争并存'],
 '团队冲突': ['关键成员互相牵制', '业务依赖与团队秩序冲突'],
 '用人与授权': ['授权效率与失控风险冲突', '人情信任与岗位校验冲突'],
 '信任与猜忌': ['低信任环境下的信号误读', '自证清白与过度解释冲突'],
 '谗言与谣言': ['非正式渠道的信息攻击难以直接对质', '决策者偏听偏信导致误判', '受害者无法自证清白又无力对抗'],
 '嫉妒与背叛': ['旧交因地位差距产生嫉妒', '曾经的信任基础被利益侵蚀', '公开对抗会失去道德高地'],
 '站队与表态': ['信息优势与表态风险并存', '短期安全与长期信用冲突'],
 '合伙与控制权': ['沟通绕过带来权力边界变化', '信任合作与控制权防线冲突'],
 '去留与进退': ['继续投入与机会成本冲突', '沉没成本与风险止损冲突'],
 '组织变革': ['变革目标与既有利益结构冲突', '速度与稳定冲突'],
 '情绪恢复': ['高压消耗与理性判断冲突', '被认可需求与现实反馈冲突']}

#: Modern words and the classical words they are expanded to.
EXPANSIONS = [(['老婆', '妻子', '媳妇', '家属', '家眷', '太太'], ['外戚', '妻妾', '后宫', '家属', '家眷']), (['谣言', '造谣', '背后说', '嚼舌根'], ['谗言', '谣言', '诬陷', '中伤', '诽谤', '诋毁']),
 (['针对', '刁难', '挤兑', '为难', '使绊子'], ['构陷', '排挤', '打压', '陷害', '离间']), (['枕边风', '吹风', '耳边风'], ['谗言', '媚', '蛊惑', '偏信', '偏听']),
 (['告状', '打小报告', '背后告状'], ['告密', '诬告', '进谗']), (['排挤', '边缘化', '架空'], ['排挤', '边缘化', '清洗', '疏远']), (['不信任', '怀疑', '猜疑'], ['猜忌', '猜疑', '疑忌', '不信任']),
 (['空降', '新来的'], ['空降', '外来', '新进']), (['抢功', '邀功', '邀宠'], ['争功', '邀功', '冒功']), (['穿小鞋', '报复', '打击报复'], ['报复', '打击', '惩罚']),
 (['心腹', '亲信', '嫡系'], ['亲信', '心腹', '宠臣', '近臣']), (['站队', '表忠心', '投靠'], ['站队', '表态', '归附']), (['被开除', '被辞退', '被干掉'], ['被诛', '被废', '被黜', '被逐']),
 (['跳槽', '离职', '走人'], ['去国', '出走', '奔他国']),
 (['嫉妒', '眼红', '见不得', '过得好', '红眼', '见不得人好', '看不惯', '不服气', '眼气', '酸'], ['嫉妒', '猜忌', '排挤', '打压', '构陷', '陷害']),
 (['好友', '发小', '同村', '兄弟', '哥们', '闺蜜'], ['同僚', '旧交', '故人', '盟友']), (['背叛', '翻脸', '背后捅刀', '反目', '决裂'], ['背叛', '反目', '反噬', '倒戈', '负义'])]

EMOTIONS = {'焦虑': ['焦虑', '担心', '不安', '害怕'],
 '压力': ['压力', '压迫', '喘不过气', '被质疑'],
 '委屈': ['委屈', '不公平', '被误解', '抢功'],
 '失落': ['失落', '灰心', '没价值'],
 '迷茫': ['迷茫', '不知道', '不确定', '该不该'],
 '疲惫': ['累', '疲惫', '尽力', '耗尽']}

FACTUAL = ['谁', '何时', '什么时候', '哪年', '哪一年', '哪里', '何地', '哪国', '几个', '哪些', '是什么', '是不是']

FACTUAL_LOOKUP = ['是谁', '谁杀了', '谁任命', '谁拥立', '谁攻打', '有哪些故事', '讲讲', '生平', '经历']

COMMENTARY = ['司马光怎么看', '司马光如何评价', '司马光评价', '司马光评论', '臣司马光曰', '司马光怎么说']

ANALYSIS = ['怎么办', '如何处理', '怎么处理', '如何管理', '怎么管理', '如何应对', '怎么应对', '如何带队', '如何用人', '相关管理问题', '本质上相关']

FIRST_PERSON = ['我', '我们', '我的', '我们团队', '我们公司', '老板', '领导', '同事', '下属', '合伙人']

DOMAIN = ['资治通鉴', '司马光', '历史', '史例', '史臣', '吴起', '智瑶', '君臣', '诸侯', '战国', '秦', '汉', '唐', '周', '晋', '魏', '赵', '韩', '楚', '齐', '燕', '老板', '领导', '同事', '下属', '汇报',
 '职场', '团队', '管理', '组织', '合伙人', '控制权']

OUT_OF_SCOPE = ['红烧肉', '菜谱', '做饭', '烹饪', '炒菜', '炖肉', '天气', '股票', '足球比分', '电影推荐', '旅游攻略', '减肥餐', 'Python报错']

#: Marks of modern prose; a word that occurs twice counts twice.
MODERN_MARKERS = ['就是', '因为', '于是', '所以', '如果', '当初', '开始', '再次', '国君', '去世', '即位', '认为', '回答', '百姓', '意思', '这是', '这样', '派人', '前去', '希望', '皇帝', '皇宫', '大赦天下', '被任命',
 '任命', '当天', '当时', '当初', '这时', '此时', '立即', '立刻', '前往', '抵达', '决定', '宣布', '打算', '命令', '告诉', '请求', '表示', '全部', '一起', '自己', '率领', '公元']

CLASSICAL_MARKERS = ['臣光曰', '曰', '矣', '焉', '哉', '乎', '耳', '盖', '夫', '弗', '薨', '寡人', '岂', '孰', '何以', '不然', '乃', '则']

PEOPLE_SUFFIXES = ['王', '公', '侯', '君', '帝', '后', '太后', '太子', '相', '将军', '大夫']

PEOPLE_FALLBACK = ['王', '公', '侯', '君', '帝', '后', '太后', '太子', '相', '将军', '使者', '大夫', '魏', '赵', '韩', '秦', '楚', '齐', '燕', '汉', '唐', '晋', '周']

EVENTS = ['为诸侯', '攻', '伐', '围', '杀', '诛', '免', '拜', '封', '立', '降', '反', '盟']

TOPICS = {'权力': ['君', '帝', '王', '位', '诸侯'],
 '用人': ['相', '将军', '用', '拜', '封'],
 '联盟': ['盟', '合从', '连横'],
 '猜忌': ['疑', '谗', '间', '忌'],
 '进退': ['退', '进', '去', '留'],
 '时机': ['时', '机', '势'],
 '信任': ['信', '诚', '托'],
 '沟通': ['言', '谏', '奏', '书'],
 '制衡': ['制', '衡', '分', '礼']}

SITUATIONS = {'君臣': ['帝', '王', '臣', '相'], '同僚': ['将军', '大夫', '同列'], '结盟': ['盟', '合从', '连横'], '离间': ['间', '谗', '疑'], '试探': ['试', '探', '窥'], '进谏': ['谏', '奏', '书']}

DROP_PREFIXES = ['<B', 'B>']

TRANSLATION_PREFIXES = ['春季', '夏季', '秋季', '冬季', '当初', '后来', '这时', '此时', '当天', '同年', '起初']

TRANSLATION_MARKERS = ['公元', '皇帝', '朝廷', '百姓', '任命', '派遣', '率领', '下令', '表示', '允许', '决定', '于是', '因此', '所以', '去世', '驾崩', '大赦天下']

ROLE_EXACT = {'最高决策者': '最高决策者/组织负责人',
 '组织最高决策者': '最高决策者/组织负责人',
 '组织负责人/最高决策者': '最高决策者/组织负责人',
 '组织最高决策者/实际控制人': '最高决策者/组织负责人',
 '新政权最高决策者': '最高决策者/组织负责人',
 '组织最高决策者/规则制定者': '最高决策者/组织负责人',
 '谈判代表/说服者': '谈判代表/受命执行者',
 '策略建议者/幕僚': '策略建议者/说服者',
 '策略建议者/高级幕僚': '策略建议者/说服者',
 '内部谋士/策略建议者': '策略建议者/说服者',
 '外部协作方/盟友': '协作方/联盟伙伴',
 '核心高管/策略建议者': '核心高管/授权执行者',
 '核心高管/关键执行者': '核心高管/授权执行者'}

ROLE_RULES = ((('组织最高决策者',), '最高决策者/组织负责人'), (('最高决策者', '组织负责人'), '最高决策者/组织负责人'), (('策略建议者', '幕僚'), '策略建议者/说服者'), (('谈判代表', '说服'), '谈判代表/受命执行者'))

#: A role with one of these is modern already.
ROLE_MARKERS = ('决策者', '负责人', '承压者', '执行者', '建议者', '说服者', '谈判代表', '接班人', '压力来源', '外部强势方', '核心高管', '内部追随者', '资深功臣', '新晋高位者', '关键筹码', '外部对手', '外部协作方', '联盟成员', '实权操盘者',
 '高风险执行者', '非常规行动者', '非正式顾问', '不确定性来源', '代理负责人', '被动承压者', '利益获得者', '被安置者')

#: Ancient role and modern role; the first that occurs wins.
ROLE_MAP = (('魏国国相', '核心高管/授权执行者'), ('齐国国相', '核心高管/授权执行者'), ('赵章国相', '共谋者/叛乱执行者'), ('秦相', '核心高管/授权执行者'), ('齐相', '核心高管/授权执行者'), ('国相', '核心高管/授权执行者'),
 ('太子师傅', '接班人辅导者/风险提醒者'), ('太子宠妃', '亲近影响者/非正式权力来源'), ('宠妃', '亲近影响者/非正式权力来源'), ('爱姬', '亲近影响者/非正式权力来源'), ('宠臣', '亲近影响者/非正式权力来源'), ('太子', '关键接班人/承压者'),
 ('王子', '继承候选人/关键接班人'), ('继承人', '关键接班人/承压者'), ('新立国君', '新任负责人/权力承接者'), ('继任国君', '新任负责人/权力承接者'), ('新君', '新任负责人/权力承接者'), ('对手君主', '外部强势方/压力来源'),
 ('赵国国君', '最高决策者/组织负责人'), ('赵国主君', '最高决策者/组织负责人'), ('国君', '最高决策者/组织负责人'), ('君主', '最高决策者/组织负责人'), ('皇帝', '最高决策者/组织负责人'), ('最高统治者', '最高决策者/组织负责人'),
 ('秦王', '外部强势方/压力来源'), ('赵王', '最高决策者/组织负责人'), ('齐王', '最高决策者/组织负责人'), ('王', '最高决策者/组织负责人'), ('相国人选', '高位候选人/被评估者'), ('相国', '核心高管/授权执行者'),
 ('丞相', '核心高管/授权执行者'), ('令尹', '核心高管/授权执行者'), ('大臣', '核心下属/内部意见提供者'), ('臣下', '核心下属/内部意见提供者'), ('臣子', '核心下属/内部意见提供者'), ('权臣', '核心高管/实权操盘者'),
 ('执政重臣', '核心高管/授权执行者'), ('受托重臣', '受托负责人/关键守护者'), ('近臣', '亲近影响者/非正式权力来源'), ('谋士', '策略建议者/说服者'), ('谋臣', '策略建议者/说服者'), ('策士', '策略建议者/说服者'),
 ('顾问', '策略建议者/说服者'), ('军师', '策略建议者/说服者'), ('说客', '外部说服者/策略推动者'), ('纵横家', '外部说服者/策略推动者'), ('预言者', '风险提示者/外部观察者'), ('赵将', '一线负责人/关键执行者'),
 ('秦将', '一线负责人/关键执行者'), ('汉将', '一线负责人/关键执行者'), ('魏军主将', '一线负责人/关键执行者'), ('联军统帅之一', '联盟一线负责人/关键执行者'), ('守城方首领', '防守负责人/关键执行者'), ('主帅', '一线负责人/关键执行者'),
 ('主将', '一线负责人/关键执行者'), ('将军', '一线负责人/关键执行者'), ('大将', '一线负责人/关键执行者'), ('将领', '一线负责人/关键执行者'), ('将才', '关键执行者/专业人才'), ('地方官', '区域负责人/绩效承压者'),
 ('使者', '谈判代表/受命执行者'), ('游说者', '外部说服者/策略推动者'), ('门客', '内部追随者/声誉压力来源'), ('下属', '内部追随者/执行压力来源'), ('质子', '被约束的关键筹码'), ('人质', '被约束的关键筹码'),
 ('争位者', '竞争候选人/秩序挑战者'), ('被废黜者', '失势负责人/被动承压者'), ('攻伐者', '外部行动方/压力制造者'), ('进谏者', '风险提醒者/内部纠偏者'), ('谏臣', '风险提醒者/内部纠偏者'), ('劝谏者', '风险提醒者/内部纠偏者'),
 ('劝说者', '说服者/关系协调者'), ('举荐者', '资源推荐者/利益相关方'), ('同盟诸侯', '外部协作方/联盟成员'), ('诸侯', '外部利益相关方/联盟成员'), ('对手', '外部对手/竞争方'), ('刺客', '高风险执行者/非常规行动者'),
 ('方士', '非正式顾问/不确定性来源'), ('受封者', '利益获得者/被安置者'), ('目标', '被动承压者/目标对象'), ('进攻方', '外部行动方/压力制造者'), ('宫廷影响者', '亲近影响者/非正式权力来源'), ('摄政者', '代理负责人/权力托管者'),
 ('候选人', '候选负责人/被评估者'), ('盟友', '协作方/联盟伙伴'), ('长子', '继承候选人/关键接班人'), ('托人复仇者', '委托方/复仇推动者'), ('受命护送者', '受命执行者/安全负责人'), ('制衡者', '制衡方/风险控制者'),
 ('授权者', '授权方/最终批准者'), ('主权者', '最高决策者/组织负责人'), ('贤士', '关键人才/外部资源'), ('变法主导者', '变革负责人/改革推动者'), ('实际操盘者', '实权操盘者/关键执行者'), ('最终决策者', '最高决策者/组织负责人'),
 ('主导者', '主导方/关键推动者'), ('受劝者', '被说服者/决策承压者'), ('被索地者', '被施压方/资源让渡者'))

#: Names of the fields in which a case was met, by what was met there.
FIELD_NAMES = {'detail': '案例细节', 'tag': '案例标签', 'role': '现代角色', 'view': '视角摘要', 'kind': '案例类型', 'sparse': '关键词线索', 'pattern': '可迁移模式', 'title': '案例标题', 'dense': '语义主线'}
COMMA = '、'
REASON = '该案例通过{{fields}}与当前问题形成对应；命中线索包括「{{terms}}」。其可迁移主线是：{{pattern}}'

#: Scenes, topics and what a text with such a topic tells in such a scene.
MAPPING_REASONS = [
 (['向上管理', '信任与猜忌'], ['信任'], '该史例强调信任与承诺对组织秩序的作用，可用于判断低信任关系中的行动边界。'),
 (['谗言与谣言'], ['谗言', '谣言', '信任', '构陷'], '该史例涉及谗言、谣言或信任危机，可映射到现代职场中非正式渠道信息攻击的应对策略。'),
 (['嫉妒与背叛'], ['嫉妒', '功高震主', '背叛', '猜忌', '反目'], '该史例涉及旧交嫉妒或盟友反目，可映射到现代关系中因地位差距导致的信任瓦解。'),
 (['合伙与控制权', '站队与表态'], ['联盟'], '该史例体现联盟失衡与反噬风险，可提醒不要把短期优势误判为长期控制力。'),
 (['团队冲突', '用人与授权'], ['用人'], '该史例对应关键岗位、授权与问责问题，可映射到现代团队管理。')]
MAPPING_OTHERWISE = '该史例与当前问题在权力关系、信任边界或行动时机上存在可借鉴的结构相似性，但不能机械套用。'

#: Who a question may be about: name, words, role; and the one who asks.
ACTORS = [('直属领导', ['直属领导', '领导', '上级'], '直接评价与资源分配者'), ('老板/更高层', ['老板', '高层', '大老板'], '更高层权力来源'), ('同事', ['同事', '跨部门'], '横向协作方'),
 ('下属/团队成员', ['下属', '团队', '核心成员'], '执行与组织稳定相关方'), ('合伙人', ['合伙人', '联合创始人'], '控制权与边界相关方'), ('外部客户/伙伴', ['客户', '供应商', '外部'], '外部压力来源')]
ASKER = ('我', '提问者', '降低风险并推进目标', '信息不足时容易被动表态')
ACTOR_GOAL, ACTOR_RISK = '维护自身利益与影响力', '可能误读信号或放大冲突'

#: Answers of a look-up without evidence, and with it.
NO_COMMENTARY, NO_FACT = '当前未检索到足以支持回答的司马光评论证据。', '当前未检索到足以支持回答的直接史实证据。'

#: What a form of a text adds to its score as modern prose: form, needles, points.
MODERN_BONUSES = [
 ('start', ['臣司马光曰'], 6), ('start', ['臣光曰'], -6), ('within', ['公元'], 2), ('match', ['（[初十廿三一二四五六七八九\\d]+日'], 3), ('match', ['（[^）]*公元[^）]*）'], 3), ('match', ['[一二三四五六七八九十]+日'], 1),
 ('start', ['周威烈王', '秦国', '魏惠王去世', '春季', '夏季', '秋季', '冬季', '当天', '当初', '这时', '此时'], 2), ('short', ['去世', '开始', '再次', '任命', '降到'], 2)]
MODERN_SHORT = 16

#: How a paragraph of a section is decided. Section numbered, paragraph numbered, what the section holds, the decision before, a further condition: outcome. None: any.
PARAGRAPH_RULES = [
 (None, None, None, None, 'known', 'original'),
 (True, True, 'nothing', None, 'originals', 'guess'),
 (True, True, 'nothing', None, None, 'original'),
 (True, True, 'originals', None, 'classical', 'original'),
 (True, True, 'originals', None, None, 'modern'),
 (True, False, None, 'original', 'long', 'modern'),
 (False, None, None, None, 'modern opening', 'modern'),
 (False, None, None, None, 'classical', 'original'),
 (None, None, None, None, None, 'guess')]
CLASSICAL_OPENING, MODERN_OPENING, LONG_PARAGRAPH = '臣光曰', '臣司马光曰', 14

#: Canonical names of roles that contain words: all of, any of, none of, greatest length (None: any), name.
ROLE_CONTAINS = [
 (['叛将'], [], [], None, '一线负责人/关键执行者'), ([], ['庶兄', '宗室'], ['/'], None, '继承竞争者/内部挑战者'), (['将'], [], ['/'], 4, '一线负责人/关键执行者')]

#: Modern roles of persons: words of the name (or the role), words of the role, words of the stance, name. One of the role's or the stance's words is enough.
PERSON_ROLES = [
 (['蔺相如'], False, ['上卿'], ['避让'], '新晋高位者/主动避让者'), (['廉颇'], False, ['大将'], ['不满', '请罪'], '资深功臣/不满者'), (['门客'], True, [], ['羞耻', '避让', '声誉'], '内部追随者/声誉压力来源')]

#: Roles that the role's or the stance's words move: role, words of the role, words of the stance, name.
MOVED_ROLES = [('一线负责人/关键执行者', [], ['不满', '功'], '资深功臣/不满者'), ('最高决策者/组织负责人', ['对手'], ['压', '胁'], '外部强势方/压力来源')]
