"""Input frames of the licence fields: tokens of driver and vehicle licences, and measures of their regions.

Every 6th image is turned by a quarter, so its lines run downwards. Rows hold labels in Chinese, in English, joined
with their values, or none at all; values whole, cut, of a wrong form, at equal distance, and between two lines.
"""

from __future__ import annotations

from docloom.sources.frames import define

#: {text} by c (the customer) and i (the place of the token); rows of 40 units, labels at 0, values at 100.
_TOKENS = """
        SELECT group_id, token_index, text, score, CASE WHEN c % 6 = 5 THEN y ELSE x END AS left, CASE WHEN c % 6 = 5 THEN x ELSE y END AS top,
               CASE WHEN c % 6 = 5 THEN y + h ELSE x + w END AS right, CASE WHEN c % 6 = 5 THEN x + w ELSE y + h END AS bottom
        FROM (SELECT c_custkey AS group_id, c_custkey AS c, CAST(i AS BIGINT) AS token_index, {text} AS text,
                     CASE WHEN (c_custkey + i) % 29 = 0 THEN NULL ELSE CAST(70 + (c_custkey * 7 + i * 13) % 31 AS DOUBLE) / 100 END AS score,
                     CAST(CASE WHEN i IN (19, 20) THEN 100 ELSE 100 * (i % 2) END + (c_custkey * i) % 7 AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y, CAST(80 + c_custkey % 3 * 10 AS DOUBLE) AS w, CAST(16 + (c_custkey + i) % 9 AS DOUBLE) AS h
              FROM {{customer}} CROSS JOIN ({places}) AS p) AS t"""
_PLACES = " UNION ALL ".join(f"SELECT {i} AS i" for i in range(21))

define("driver_tokens", _TOKENS.format(places=_PLACES, y="CASE WHEN i = 19 THEN 160 WHEN i = 20 THEN 140 + c_custkey % 50 ELSE 40 * floor(i / 2) + (c_custkey * (i + 3)) % 11 END", text="""
          CASE i WHEN 0 THEN CASE c_custkey % 7 WHEN 0 THEN 'stain' WHEN 1 THEN concat('证号', lpad(CAST(c_custkey AS STRING), 18, '4')) ELSE '证 号：' END
            WHEN 1 THEN CASE c_custkey % 5 WHEN 0 THEN concat(lpad(CAST(c_custkey AS STRING), 17, '4'), 'x') WHEN 1 THEN lpad(CAST(c_custkey AS STRING), 12, '4') WHEN 2 THEN '' ELSE lpad(CAST(c_custkey AS STRING), 18, '4') END
            WHEN 2 THEN CASE c_custkey % 4 WHEN 0 THEN 'Name' WHEN 1 THEN '姓名王小二' WHEN 2 THEN '姓名' ELSE 'nationality / name' END
            WHEN 3 THEN CASE c_custkey % 5 WHEN 0 THEN '公安' WHEN 1 THEN '李' WHEN 2 THEN NULL ELSE '李大龙' END
            WHEN 4 THEN CASE c_custkey % 3 WHEN 0 THEN '性别 Sex' WHEN 1 THEN 'SEX' ELSE '性别男' END WHEN 5 THEN CASE c_custkey % 3 WHEN 0 THEN '男' WHEN 1 THEN '女' ELSE '中国 CHN' END
            WHEN 6 THEN CASE c_custkey % 4 WHEN 0 THEN '国籍' ELSE 'Nationality' END WHEN 7 THEN CASE c_custkey % 3 WHEN 0 THEN 'chn' WHEN 1 THEN '中国' ELSE 'CHM' END
            WHEN 8 THEN CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '住址广东省' ELSE '住址' END
            WHEN 9 THEN CASE c_custkey % 6 WHEN 0 THEN '广东省' WHEN 1 THEN '中山市公安局' WHEN 2 THEN '广州' ELSE '广东省中山市一号街二号' END
            WHEN 10 THEN CASE c_custkey % 3 WHEN 0 THEN '出生日期' ELSE 'Date of Birth' END WHEN 11 THEN CASE c_custkey % 4 WHEN 0 THEN '1990-01-02' WHEN 1 THEN '19900102' WHEN 2 THEN '1990年1月2日' ELSE '1990.1.2' END
            WHEN 12 THEN CASE c_custkey % 3 WHEN 0 THEN '准驾车型' WHEN 1 THEN 'class' ELSE '' END WHEN 13 THEN CASE c_custkey % 4 WHEN 0 THEN 'c1' WHEN 1 THEN 'A1D' WHEN 2 THEN 'D' ELSE 'Z' END
            WHEN 14 THEN CASE c_custkey % 4 WHEN 0 THEN 'Valid Period' WHEN 1 THEN '有效期限长期' ELSE '有效期限' END
            WHEN 15 THEN CASE c_custkey % 6 WHEN 0 THEN '2020-01-01至2026-01-01' WHEN 1 THEN '长期' WHEN 2 THEN '2020至20260101' WHEN 3 THEN '20200101到2026' WHEN 4 THEN '20200101' ELSE '20201' END
            WHEN 16 THEN '档案编号' WHEN 17 THEN lpad(CAST(c_custkey AS STRING), 12, '5') WHEN 18 THEN CASE c_custkey % 2 WHEN 0 THEN lpad(CAST(c_custkey AS STRING), 18, '4') ELSE 'C2' END
            WHEN 19 THEN CASE c_custkey % 3 WHEN 0 THEN '广东省中山市三号街四号' ELSE '出生日期记录' END ELSE CASE c_custkey % 4 WHEN 0 THEN '深圳市南山区' WHEN 1 THEN 'background' ELSE NULL END END"""))  # fmt: skip
define("vehicle_tokens", _TOKENS.format(places=_PLACES, y="CASE WHEN i = 19 THEN 80 WHEN i = 20 THEN 60 + c_custkey % 50 ELSE 40 * floor(i / 2) + (c_custkey * (i + 3)) % 11 END", text="""
          CASE i WHEN 0 THEN CASE c_custkey % 5 WHEN 0 THEN '号牌' WHEN 1 THEN 'Plate No.' WHEN 2 THEN concat('号牌号码 Plate No. 粤A', lpad(CAST(c_custkey AS STRING), 5, '6')) ELSE '号牌号码' END
            WHEN 1 THEN CASE c_custkey % 4 WHEN 0 THEN concat('粤A', lpad(CAST(c_custkey AS STRING), 5, '6')) WHEN 1 THEN concat('粤A', CAST(c_custkey % 100 AS STRING)) WHEN 2 THEN '小型汽车' ELSE concat('甲A', lpad(CAST(c_custkey AS STRING), 5, '6')) END
            WHEN 2 THEN CASE c_custkey % 3 WHEN 0 THEN '所有人 Owner' WHEN 1 THEN '所有人' ELSE '所有人张三 Owner' END
            WHEN 3 THEN CASE c_custkey % 5 WHEN 0 THEN 'Owne' WHEN 1 THEN '所有' WHEN 2 THEN '' WHEN 3 THEN '张小三' ELSE '使用性质' END
            WHEN 4 THEN CASE c_custkey % 4 WHEN 0 THEN '住' WHEN 1 THEN 'Address' ELSE '住址' END WHEN 5 THEN CASE c_custkey % 4 WHEN 0 THEN '址' WHEN 1 THEN '镇' ELSE '广东省深圳市' END
            WHEN 6 THEN CASE c_custkey % 3 WHEN 0 THEN '车辆识别代号 VIN' WHEN 1 THEN 'VIN' ELSE 'Vehicle Identification Number' END WHEN 7 THEN CASE c_custkey % 3 WHEN 0 THEN concat('LSV', lpad(CAST(c_custkey AS STRING), 14, '1')) WHEN 1 THEN concat('LSV', CAST(c_custkey AS STRING), '11111*11') ELSE 'LSV' END
            WHEN 8 THEN CASE c_custkey % 3 WHEN 0 THEN '发动机号码' WHEN 1 THEN '发动机号8T' ELSE 'Engine No.' END WHEN 9 THEN CASE c_custkey % 3 WHEN 0 THEN '12345678' WHEN 1 THEN '总质量' ELSE '发动机号 12' END
            WHEN 10 THEN '注册日期' WHEN 11 THEN '2020-01-02' WHEN 12 THEN 'Model' WHEN 13 THEN '大众牌' WHEN 14 THEN '外廓尺寸' WHEN 15 THEN '4500X1800X1500mm' WHEN 16 THEN '整备质量' WHEN 17 THEN '1200kg'
            WHEN 18 THEN CASE c_custkey % 2 WHEN 0 THEN concat('京B', lpad(CAST(c_custkey AS STRING), 5, '7')) ELSE '档案号码' END
            WHEN 19 THEN CASE c_custkey % 3 WHEN 0 THEN '福田区一号' ELSE NULL END ELSE CASE c_custkey % 4 WHEN 0 THEN '南山区' WHEN 1 THEN concat('粤B', lpad(CAST(c_custkey AS STRING), 5, '8')) ELSE 'bumper' END END"""))  # fmt: skip
