"""Forty golden rows: id, type, an answer that is right, number and tolerance, keys, forbidden keys, refusal. Fixed values."""

ROWS = [
    ('Q001', 'lookup', '$2,833.0 million (approximately $2.83 billion).', 2833.0, 0.5, ['2,833.0'], [], False),
    ('Q002', 'lookup', 'MFWX, on the Nasdaq Global Select Market.', None, None, ['MFWX', 'Nasdaq'], [], False),
    ('Q003', 'lookup', 'Adaeze Okonkwo, appointed in March 2023.', None, None, ['Okonkwo'], [], False),
    ('Q004', 'lookup', '11,482 employees.', 11482.0, 0.0, ['11,482'], [], False),
    ('Q005', 'lookup', '$2.01 per diluted share.', 2.01, 0.005, ['2.01'], [], False),
    ('Q006', 'lookup', 'Ground Freight, Cold Chain, and Digital Platform.', None, None, ['Ground Freight', 'Cold Chain', 'Digital Platform'], [], False),
    ('Q007', 'lookup', '43 distribution centers and 12 dedicated cold-storage facilities.', None, None, ['43', '12'], [], False),
    ('Q008', 'lookup', '13.0 percent.', 13.0, 0.05, ['13.0'], [], False),
    ('Q009', 'lookup', '118 percent.', 118.0, 0.5, ['118'], [], False),
    ('Q010', 'lookup', '$18.5 million.', 18.5, 0.05, ['18.5'], [], False),
    ('Q011', 'lookup', '$3.05 billion to $3.15 billion.', None, None, ['3.05', '3.15'], [], False),
    ('Q012', 'lookup', '31.4 percent.', 31.4, 0.05, ['31.4'], [], False),
    ('Q013', 'lookup', '214,600 tCO2e.', 214600.0, 0.0, ['214,600'], [], False),
    ('Q014', 'lookup', '$125.0 million, repurchasing 2.4 million shares.', None, None, ['125.0', '2.4'], [], False),
    ('Q015', 'lookup', '$12.4 million, including equity awards valued at $9.1 million and a base salary of $1.15 million.', 12.4, 0.05, ['12.4'], [], False),
    ('Q016', 'temporal', '$2,505.4 million.', 2505.4, 0.5, ['2,505.4'], [], False),
    ('Q017', 'temporal', '92.8 percent.', 92.8, 0.05, ['92.8'], [], False),
    ('Q018', 'temporal', '41 units.', 41.0, 0.0, ['41'], [], False),
    ('Q019', 'temporal', '58 percent.', 58.0, 0.5, ['58'], [], False),
    ('Q020', 'distractor', 'Marcus Reyes, Senior Vice President, Cold Chain.', None, None, ['Marcus Reyes'], ['Marisol'], False),
    ('Q021', 'distractor', 'Marisol Reyes, who joined in January 2024.', None, None, ['Marisol Reyes'], ['Marcus'], False),
    ('Q022', 'distractor', '$271.4 million in ARR, versus $256.3 million of segment revenue.', 271.4, 0.05, ['271.4'], [], False),
    ('Q023', 'multi_hop', 'Digital Platform, at 24.0 percent.', None, None, ['Digital Platform', '24.0'], [], False),
    ('Q024', 'multi_hop', 'Digital Platform grew fastest at 43.7 percent. It employed 986 people versus 7,236 in Ground Freight, roughly one-seventh as many.', None, None, ['Digital Platform', '43.7', '986', '7,236'], [], False),
    ('Q025', 'multi_hop', 'The Cold Chain segment; the customer represents 8.7 percent of consolidated revenue.', None, None, ['Cold Chain', '8.7'], [], False),
    ('Q026', 'multi_hop', 'Fiscal 2026 guidance excludes the effect of the Kestrel Cold Storage acquisition, which was announced February 11, 2026 for $148.0 million and is expected to close in Q2 2026.', None, None, ['exclude', 'Kestrel'], [], False),
    ('Q027', 'multi_hop', 'Stock-based compensation of $61.4 million, restructuring charges of $22.9 million, and an $18.5 million legal accrual — $102.8 million combined.', 102.8, 0.05, ['61.4', '22.9', '18.5'], [], False),
    ('Q028', 'arithmetic', '$224.7 million: $391.2 million of operating cash flow less $166.5 million of capital expenditures.', 224.7, 0.05, ['224.7'], [], False),
    ('Q029', 'arithmetic', 'Approximately 25.9 percent ($734.1M of $2,833.0M).', 25.9, 0.2, ['734.1', '2,833.0'], [], False),
    ('Q030', 'arithmetic', '$327.6 million ($2,833.0M less $2,505.4M).', 327.6, 0.5, ['2,833.0', '2,505.4'], [], False),
    ('Q031', 'arithmetic', 'Approximately 24.5 percent ($54.9M of tax on $224.0M pre-tax income).', 24.5, 0.3, ['54.9', '224.0'], [], False),
    ('Q032', 'arithmetic', 'Q4 2025 at $753.6 million, which was $91.2 million above the lowest quarter, Q1 at $662.4 million.', 91.2, 0.5, ['753.6', '662.4'], [], False),
    ('Q033', 'arithmetic', 'Approximately 42.8 percent (4,918 of 11,482).', 42.8, 0.3, ['4,918'], [], False),
    ('Q034', 'synthesis', 'The Digital Platform segment grew 43.7 percent and reached about nine percent of revenue at roughly four times the operating margin of the ground network, while Cold Chain grew 19.8 percent and delivered its first full year of double-digit operating margins. the group also shed about $40 million of low-margin brokered volume rather than compete on price.', None, None, ['Digital Platform', 'Cold Chain'], [], False),
    ('Q035', 'synthesis', 'Driver availability, fuel price volatility, freight cycle exposure, customer concentration, and cybersecurity.', None, None, ['Driver', 'fuel', 'concentration', 'ybersecurity'], [], False),
    ('Q036', 'unanswerable', 'Not stated. The report covers fiscal 2025 and only provides fiscal 2026 guidance of $3.05-$3.15 billion, not actual results.', None, None, [], [], True),
    ('Q037', 'unanswerable', "Not stated. The report discloses only the CEO's compensation, not the CFO's.", None, None, [], [], True),
    ('Q038', 'unanswerable', 'Not stated. The report gives a total of 43 distribution centers and says Ground Freight serves Canada, but provides no country-level breakdown.', None, None, [], [], True),
    ('Q039', 'unanswerable', 'The agreed price is $148.0 million, but the deal had not closed. It was announced February 11, 2026 and was expected to close in the second quarter of fiscal 2026.', None, None, ['148.0'], [], True),
    ('Q040', 'unanswerable', 'Not stated. The report gives share counts and equity but no share price or market capitalization.', None, None, [], [], True),
]
