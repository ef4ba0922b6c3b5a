"""Input frames of the identity queries: texts of cards and licences with readings that agree, differ, are cut or have noise between."""

from __future__ import annotations

from docloom.sources.frames import define

_N, _K = "chr(10)", "c_custkey"
_FIRST = "concat(CASE WHEN c_custkey % 8 = 3 THEN concat(substring(r_name, 1, 2), '#', substring(r_name, 4, 50)) ELSE r_name END, n_name, CASE WHEN c_custkey % 9 = 5 THEN concat('#', substring(c_mktsegment, 2, 50)) ELSE c_mktsegment END, '甲乙丙')"
_SECOND = "concat('丁戊', CAST(c_custkey % 90 AS STRING), '村', CASE WHEN c_custkey % 2 = 0 THEN '组' ELSE '路' END)"
_NUMBER = "CASE c_custkey % 4 WHEN 0 THEN '11010519491231002X' WHEN 1 THEN '11010519491231002x 110105194912310038' WHEN 2 THEN '110105194912310021' ELSE '110105194912310038' END"

define("card_texts", f"""
        SELECT c_custkey AS id,
               concat('[图片 1]', {_N}, '姓名 ', c_name, {_N},
                      CASE c_custkey % 5 WHEN 0 THEN '住址：' WHEN 1 THEN concat('住址', {_N}, 'Address', {_N}) WHEN 2 THEN concat('住址 :', {_N}) WHEN 3 THEN concat('address ', {_N}) ELSE '住 址' END, {_FIRST}, {_N},
                      CASE c_custkey % 7 WHEN 0 THEN concat('全安店念发一', {_N}) WHEN 1 THEN concat('ADDRESS', {_N}) ELSE '' END, {_SECOND}, {_N},
                      CASE c_custkey % 6 WHEN 0 THEN concat('221', {_N}) WHEN 1 THEN concat('签发机关某局', {_N}) WHEN 2 THEN concat('Class C1', {_N}) ELSE '' END, '公民身份号码 ', {_NUMBER}, {_N},
                      CASE WHEN c_custkey % 3 = 0 THEN 'end' ELSE concat('[图片 2]', {_N}, '住址', {_N}, {_FIRST}, {_N}, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE concat(' ', {_SECOND}, {_N}) END, '有效期限 长期', {_N}) END,
                      CASE c_custkey % 10 WHEN 0 THEN concat('[驾驶证版式归一化/住址]', {_N}, {_FIRST}, ' ', {_SECOND}, {_N}) WHEN 1 THEN concat('[驾驶证版式归一化/住址] ', {_N}, {_N}, '甲乙**', {_N}, '[驾驶证版式归一化/住址]', {_N}, '庚辛路') ELSE '' END) AS text,
               CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN concat({_FIRST}, {_SECOND}, '221') WHEN 2 THEN concat({_FIRST}, '念发', {_SECOND}) WHEN 3 THEN concat({_FIRST}, '**') WHEN 4 THEN concat(r_name, '＊村') ELSE concat({_FIRST}, ' ', {_SECOND}) END AS address,
               CASE c_custkey % 3 WHEN 0 THEN '19800101' WHEN 1 THEN '' ELSE '1980' END AS birth
        FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey""".replace("{{", "{").replace("}}", "}"))
define("labelled_texts", f"""
        SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'driver' WHEN 1 THEN 'identity' WHEN 2 THEN 'vehicle' ELSE 'other' END AS profile,
               CASE c_custkey % 4
                 WHEN 0 THEN concat('姓名', CASE c_custkey % 3 WHEN 0 THEN {_N} WHEN 1 THEN '： ' ELSE ' ' END, '王', CAST(c_custkey AS STRING), ' 性别 男 国籍:中国', {_N}, CASE WHEN c_custkey % 5 = 0 THEN 'address ' ELSE '住址 ' END, {_FIRST}, {_SECOND}, {_N},
                                    'Date of Birth 1980-1-', CAST(2 + c_custkey % 7 AS STRING), {_N}, '初次领证日期', {_N}, '2010年03月07日', {_N}, 'Class  ', CASE c_custkey % 3 WHEN 0 THEN 'c1' ELSE 'B2, e' END, {_N},
                                    '有效期限 2020-01-02 至 2030-01-02', {_N}, '证号 1101', lpad(CAST(c_custkey AS STRING), 14, '0'), ' 记录。', {_N}, '档案编号：', lpad(CAST(c_custkey AS STRING), 12, '3'))
                 WHEN 1 THEN concat(CASE WHEN c_custkey % 3 = 0 THEN '中华人民共和国居民 身份证' ELSE 'card' END, {_N}, 'Name ', '李', CAST(c_custkey AS STRING), ' 民族 汉', {_N}, '出生 1949年12月31日', {_N}, '性别女 ', {_N},
                                    '住址 ', {_FIRST}, {_SECOND}, {_N}, '公民身份号码', {_N}, '11010519491231002x', {_N}, '签发机', {_N}, '某市公安局', {_N}, '有效期限 2010.01.02-长期')
                 ELSE concat('号牌号码 京A', lpad(CAST(c_custkey AS STRING), 5, '0'), ' 车辆类型 小型轿车', {_N}, '所有人：张', CAST(c_custkey AS STRING), {_N}, '使用性质 非营运 品牌型号 AB', CAST(c_custkey AS STRING), {_N},
                             '注册日期 2019-02-03 发证日期 2020-01-05', {_N}, '核定载质量 1500 kg', {_N}, '核定载人数 7 人', {_N}, '发动机号码') END AS text
        FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey""".replace("{{", "{").replace("}}", "}"))
