"""Integer and boolean output columns per registered query (generated by tools/gen_output_types.py)."""

OUTPUT_TYPES = {'active_base_asof': {'bools': (), 'ints': ('college_id', 'active_base')},
 'active_base_current': {'bools': (), 'ints': ('college_id', 'active_base')},
 'activity_counts_month': {'bools': (), 'ints': ('college_id', 'new_enrol', 'pauses', 'archives')},
 'activity_counts_prior': {'bools': (),
                           'ints': ('college_id',
                                    'new_enrol_m1',
                                    'pauses_m1',
                                    'archives_m1',
                                    'new_enrol_m1_mtd',
                                    'new_enrol_y1',
                                    'new_enrol_y1_mtd')},
 'activity_counts_prior_current': {'bools': (),
                                   'ints': ('college_id',
                                            'new_enrol_m1',
                                            'pauses_m1',
                                            'archives_m1',
                                            'new_enrol_m1_mtd',
                                            'new_enrol_y1',
                                            'new_enrol_y1_mtd')},
 'activity_counts_prior_rollup': {'bools': (),
                                  'ints': ('college_id',
                                           'new_enrol_m1',
                                           'pauses_m1',
                                           'archives_m1',
                                           'new_enrol_m1_mtd',
                                           'new_enrol_y1',
                                           'new_enrol_y1_mtd')},
 'additional_items': {'bools': (), 'ints': ('college_id',)},
 'admission_mix': {'bools': (), 'ints': ('pba', 'rpl', 'standard')},
 'avg_share_per_degree_3m': {'bools': (), 'ints': ('college_id', 'degree_id')},
 'avg_share_per_tenant': {'bools': (), 'ints': ('college_id',)},
 'completion_rates': {'bools': (), 'ints': ('college_id',)},
 'completion_rates_current': {'bools': (), 'ints': ('college_id',)},
 'completion_rates_rollup': {'bools': (), 'ints': ('college_id',)},
 'conversion_admission_counts': {'bools': (), 'ints': ('college_id', 'st_converted_this_month', 'pba_count')},
 'conversion_age_bands': {'bools': (), 'ints': ('cnt',)},
 'degree_fee_pivot': {'bools': (), 'ints': ('college_id', 'degree_id')},
 'dim_featured_courses': {'bools': (), 'ints': ()},
 'dim_fees': {'bools': (), 'ints': ('fee',)},
 'dim_projections': {'bools': (), 'ints': ('projected',)},
 'dim_short_names': {'bools': (), 'ints': ('college_id',)},
 'dim_squads': {'bools': (), 'ints': ()},
 'display_columns': {'bools': (), 'ints': ('college_id',)},
 'enrolment_extras': {'bools': (), 'ints': ('college_id', 'rpl_admission', 'st_wlh_count')},
 'enrolment_overview_seat': {'bools': ('eom_est_fallback', 'eom_met'),
                             'ints': ('college_id',
                                      'projected',
                                      'new_enrol',
                                      'eom_est',
                                      'eom_pct_of_proj',
                                      'new_enrol_m1',
                                      'delta_m1',
                                      'new_enrol_y1',
                                      'delta_y1',
                                      'st_till_last_month',
                                      'st_wlh_count',
                                      'st_new_this_month',
                                      'st_converted_this_month',
                                      'pba_count',
                                      'rpl_admission',
                                      'rpl_low',
                                      'rpl_high',
                                      'featured_enrolments',
                                      'active_base',
                                      'pauses_m1',
                                      'archives_m1',
                                      'net_additions')},
 'enrolment_overview_seat_total': {'bools': ('eom_met',),
                                   'ints': ('new_enrol',
                                            'eom_est',
                                            'new_enrol_m1',
                                            'new_enrol_m1_mtd',
                                            'new_enrol_y1',
                                            'new_enrol_y1_mtd',
                                            'st_till_last_month',
                                            'st_wlh_count',
                                            'st_new_this_month',
                                            'st_converted_this_month',
                                            'pba_count',
                                            'rpl_admission',
                                            'rpl_low',
                                            'rpl_high',
                                            'featured_enrolments',
                                            'active_base',
                                            'pauses_m1',
                                            'archives_m1',
                                            'net_additions',
                                            'projected',
                                            'eom_pct_of_proj',
                                            'delta_m1',
                                            'delta_y1')},
 'enrolment_overview_share': {'bools': ('eom_est_fallback', 'eom_met'),
                              'ints': ('college_id',
                                       'projected',
                                       'new_enrol',
                                       'eom_est',
                                       'eom_pct_of_proj',
                                       'new_enrol_m1',
                                       'delta_m1',
                                       'new_enrol_y1',
                                       'delta_y1',
                                       'st_till_last_month',
                                       'st_wlh_count',
                                       'st_new_this_month',
                                       'st_converted_this_month',
                                       'pba_count',
                                       'rpl_admission',
                                       'rpl_low',
                                       'rpl_high',
                                       'featured_enrolments',
                                       'archived_30d',
                                       'net_revsh')},
 'enrolment_overview_share_total': {'bools': ('eom_met',),
                                    'ints': ('new_enrol',
                                             'eom_est',
                                             'new_enrol_m1',
                                             'new_enrol_m1_mtd',
                                             'new_enrol_y1',
                                             'new_enrol_y1_mtd',
                                             'st_till_last_month',
                                             'st_wlh_count',
                                             'st_new_this_month',
                                             'st_converted_this_month',
                                             'pba_count',
                                             'rpl_admission',
                                             'rpl_low',
                                             'rpl_high',
                                             'featured_enrolments',
                                             'archived_30d',
                                             'net_revsh',
                                             'projected',
                                             'eom_pct_of_proj',
                                             'delta_m1',
                                             'delta_y1')},
 'enrolment_page_seat': {'bools': ('eom_est_fallback', 'eom_met', 'is_total'),
                         'ints': ('college_id',
                                  'projected',
                                  'new_enrol',
                                  'eom_est',
                                  'eom_pct_of_proj',
                                  'new_enrol_m1',
                                  'delta_m1',
                                  'new_enrol_y1',
                                  'delta_y1',
                                  'st_till_last_month',
                                  'st_wlh_count',
                                  'st_new_this_month',
                                  'st_converted_this_month',
                                  'pba_count',
                                  'rpl_admission',
                                  'rpl_low',
                                  'rpl_high',
                                  'featured_enrolments',
                                  'active_base',
                                  'pauses_m1',
                                  'archives_m1',
                                  'net_additions',
                                  'new_enrol_m1_mtd',
                                  'new_enrol_y1_mtd')},
 'enrolment_page_share': {'bools': ('eom_est_fallback', 'eom_met', 'is_total'),
                          'ints': ('college_id',
                                   'projected',
                                   'new_enrol',
                                   'eom_est',
                                   'eom_pct_of_proj',
                                   'new_enrol_m1',
                                   'delta_m1',
                                   'new_enrol_y1',
                                   'delta_y1',
                                   'st_till_last_month',
                                   'st_wlh_count',
                                   'st_new_this_month',
                                   'st_converted_this_month',
                                   'pba_count',
                                   'rpl_admission',
                                   'rpl_low',
                                   'rpl_high',
                                   'featured_enrolments',
                                   'archived_30d',
                                   'net_revsh',
                                   'new_enrol_m1_mtd',
                                   'new_enrol_y1_mtd')},
 'eom_estimate': {'bools': ('eom_est_fallback', 'eom_met'),
                  'ints': ('college_id', 'new_enrol', 'projected', 'eom_est', 'eom_pct_of_proj')},
 'exemption_counts': {'bools': (), 'ints': ('college_id', 'rpl_low', 'rpl_high')},
 'expected_share_revenue': {'bools': (), 'ints': ('college_id', 'est_from_min_rev')},
 'featured_course_counts': {'bools': (), 'ints': ('college_id', 'featured_enrolments')},
 'fees_from_json': {'bools': (), 'ints': ()},
 'funnel_extras': {'bools': (),
                   'ints': ('wlh_count',
                            'age_0_6m',
                            'age_6_12m',
                            'age_12pm',
                            'conv_total',
                            'adm_standard',
                            'adm_pba',
                            'adm_rpl',
                            'enrol_total')},
 'graduation_summary': {'bools': (), 'ints': ('college_id', 'total_graduates', 'total_enrolled')},
 'graduation_trend': {'bools': (), 'ints': ('college_id', 'graduates')},
 'invoice_breakdown': {'bools': (), 'ints': ('college_id',)},
 'latest_phase': {'bools': (), 'ints': ('college_id', 'phase_id')},
 'lead_conversion': {'bools': (),
                     'ints': ('college_id',
                              'st_till_last_month',
                              'st_new_this_month',
                              'st_converted_this_month',
                              'unconverted_gap')},
 'lead_counts': {'bools': (), 'ints': ('college_id', 'st_till_last_month', 'st_new_this_month')},
 'lead_funnel': {'bools': (), 'ints': ('st_till', 'st_new', 'st_converted', 'enrolled')},
 'lead_trend': {'bools': (), 'ints': ('college_id', 'new_st')},
 'lead_workload': {'bools': (), 'ints': ('college_id', 'st_wlh_count')},
 'momentum_last4': {'bools': (), 'ints': ('college_id',)},
 'monthly_invoice_purchases': {'bools': (), 'ints': ('college_id',)},
 'monthly_mtd_history': {'bools': (), 'ints': ('college_id', 'mtd_count', 'total_month')},
 'monthly_mtd_history_rollup': {'bools': (), 'ints': ('college_id', 'mtd_count', 'total_month')},
 'mtd_rates': {'bools': (), 'ints': ('college_id', 'total_month')},
 'new_enrolment_tuition': {'bools': (), 'ints': ('degree_student_id', 'college_id', 'degree_id')},
 'opportunity_flags': {'bools': (), 'ints': ('college_id',)},
 'period_delta': {'bools': (),
                  'ints': ('college_id',
                           'new_enrol',
                           'new_enrol_m1_mtd',
                           'delta_m1',
                           'new_enrol_y1_mtd',
                           'delta_y1')},
 'pricing_config': {'bools': (), 'ints': ('college_id',)},
 'projection_variance': {'bools': ('variance_mtd_based',),
                         'ints': ('college_id', 'new_enrol', 'projected', 'variance')},
 'quarterly_invoice_lines': {'bools': (), 'ints': ('college_id',)},
 'refund_window_archives': {'bools': (), 'ints': ('college_id', 'archived_30d')},
 'revenue_components': {'bools': (), 'ints': ('college_id',)},
 'revenue_overview': {'bools': ('has_invoice',), 'ints': ('college_id',)},
 'revenue_overview_total': {'bools': (), 'ints': ('tenants', 'with_invoice')},
 'revenue_page': {'bools': ('has_invoice', 'is_total'), 'ints': ('college_id', 'tenants', 'with_invoice')},
 'rpl_admissions': {'bools': (), 'ints': ('college_id', 'rpl_admission')},
 'run_query': {'bools': (), 'ints': ('id',)},
 'seasonal_factor': {'bools': (), 'ints': ('college_id',)},
 'seat_eom_revenue': {'bools': (), 'ints': ()},
 'seat_expected_revenue_asof': {'bools': (), 'ints': ('college_id',)},
 'seat_expected_revenue_current': {'bools': (), 'ints': ('college_id',)},
 'seat_fee_per_degree': {'bools': (), 'ints': ('college_id', 'degree_id')},
 'seat_overview': {'bools': ('variance_mtd_based',),
                   'ints': ('college_id',
                            'active_base',
                            'projected',
                            'new_enrol',
                            'new_enrol_m1',
                            'new_enrol_y1',
                            'delta_m1',
                            'delta_y1',
                            'variance',
                            'pauses_m1',
                            'archives_m1',
                            'net_additions',
                            'st_till_last_month',
                            'st_new_this_month',
                            'st_converted_this_month',
                            'rpl_low',
                            'rpl_high',
                            'pba_count',
                            'featured_enrolments')},
 'seat_overview_total': {'bools': (),
                         'ints': ('new_enrol',
                                  'new_enrol_m1',
                                  'new_enrol_y1',
                                  'new_enrol_m1_mtd',
                                  'new_enrol_y1_mtd',
                                  'eom_enrol',
                                  'active_base',
                                  'pauses_m1',
                                  'archives_m1',
                                  'net_additions',
                                  'st_till_last_month',
                                  'st_new_this_month',
                                  'st_converted_this_month',
                                  'rpl_low',
                                  'rpl_high',
                                  'pba_count',
                                  'featured_enrolments',
                                  'projected',
                                  'eom_variance',
                                  'delta_m1',
                                  'delta_y1')},
 'seat_page': {'bools': ('variance_mtd_based', 'is_total'),
               'ints': ('college_id',
                        'active_base',
                        'projected',
                        'new_enrol',
                        'new_enrol_m1',
                        'new_enrol_y1',
                        'delta_m1',
                        'delta_y1',
                        'variance',
                        'pauses_m1',
                        'archives_m1',
                        'net_additions',
                        'st_till_last_month',
                        'st_new_this_month',
                        'st_converted_this_month',
                        'rpl_low',
                        'rpl_high',
                        'pba_count',
                        'featured_enrolments',
                        'new_enrol_m1_mtd',
                        'new_enrol_y1_mtd',
                        'eom_enrol',
                        'eom_variance')},
 'section_kpis': {'bools': (),
                  'ints': ('tenants',
                           'new_enrol',
                           'pauses_m1',
                           'archives_m1',
                           'net_additions',
                           'archived_30d',
                           'net_revsh')},
 'share_eom_revenue': {'bools': (), 'ints': ()},
 'share_overview': {'bools': ('variance_mtd_based', 'share_rev_approximate'),
                    'ints': ('college_id',
                             'projected',
                             'new_enrol',
                             'new_enrol_m1',
                             'new_enrol_y1',
                             'delta_m1',
                             'delta_y1',
                             'variance',
                             'archived_30d',
                             'net_revsh',
                             'st_till_last_month',
                             'st_new_this_month',
                             'st_converted_this_month',
                             'rpl_low',
                             'rpl_high',
                             'pba_count',
                             'featured_enrolments')},
 'share_overview_total': {'bools': (),
                          'ints': ('new_enrol',
                                   'new_enrol_m1',
                                   'new_enrol_y1',
                                   'new_enrol_m1_mtd',
                                   'new_enrol_y1_mtd',
                                   'eom_enrol',
                                   'archived_30d',
                                   'net_revsh',
                                   'st_till_last_month',
                                   'st_new_this_month',
                                   'st_converted_this_month',
                                   'rpl_low',
                                   'rpl_high',
                                   'pba_count',
                                   'featured_enrolments',
                                   'projected',
                                   'eom_variance',
                                   'delta_m1',
                                   'delta_y1')},
 'share_page': {'bools': ('variance_mtd_based', 'share_rev_approximate', 'is_total'),
                'ints': ('college_id',
                         'projected',
                         'new_enrol',
                         'new_enrol_m1',
                         'new_enrol_y1',
                         'delta_m1',
                         'delta_y1',
                         'variance',
                         'archived_30d',
                         'net_revsh',
                         'st_till_last_month',
                         'st_new_this_month',
                         'st_converted_this_month',
                         'rpl_low',
                         'rpl_high',
                         'pba_count',
                         'featured_enrolments',
                         'new_enrol_m1_mtd',
                         'new_enrol_y1_mtd',
                         'eom_enrol',
                         'eom_variance')},
 'snapshot_read': {'bools': (), 'ints': ('college_id', 'new_enrol', 'pauses', 'archives')},
 'snapshot_refresh': {'bools': (), 'ints': ('rows',)},
 'squad_lead_funnel': {'bools': (), 'ints': ('st_till', 'st_new', 'st_converted', 'enrolled')},
 'squad_members_report': {'bools': (),
                          'ints': ('college_id',
                                   'new_enrol',
                                   'pauses',
                                   'archives',
                                   'new_enrol_m1',
                                   'pauses_m1',
                                   'archives_m1',
                                   'new_enrol_m1_mtd',
                                   'new_enrol_y1',
                                   'new_enrol_y1_mtd',
                                   'active_base',
                                   'st_converted_this_month',
                                   'pba_count',
                                   'archived_30d',
                                   'st_till_last_month',
                                   'st_new_this_month',
                                   'rpl_low',
                                   'rpl_high',
                                   'featured_enrolments',
                                   'est_from_min_rev',
                                   'net_additions',
                                   'net_revsh')},
 'squad_report': {'bools': (),
                  'ints': ('college_id',
                           'new_enrol',
                           'pauses',
                           'archives',
                           'new_enrol_m1',
                           'pauses_m1',
                           'archives_m1',
                           'new_enrol_m1_mtd',
                           'new_enrol_y1',
                           'new_enrol_y1_mtd',
                           'active_base',
                           'st_converted_this_month',
                           'pba_count',
                           'archived_30d',
                           'st_till_last_month',
                           'st_new_this_month',
                           'rpl_low',
                           'rpl_high',
                           'featured_enrolments',
                           'est_from_min_rev',
                           'net_additions',
                           'net_revsh')},
 'table_binding_activities': {'bools': (), 'ints': ('user_id', 'college_id', 'degree_id')},
 'table_binding_ams_course_students': {'bools': (), 'ints': ('id', 'course_id')},
 'table_binding_courses': {'bools': (), 'ints': ('id', 'college_id')},
 'table_binding_custom_prices': {'bools': (), 'ints': ('invoice_id', 'quantity')},
 'table_binding_degree_student_services': {'bools': (), 'ints': ('degree_student_id',)},
 'table_binding_degree_students': {'bools': ('has_activity_before_invitation', 'is_pba_converted'),
                                   'ints': ('id',
                                            'user_id',
                                            'college_id',
                                            'degree_id',
                                            'rpl_exemption_request_id')},
 'table_binding_degrees': {'bools': (), 'ints': ('id', 'college_id')},
 'table_binding_invoice_purchase_overrides': {'bools': (), 'ints': ('degree_student_id',)},
 'table_binding_invoices': {'bools': (), 'ints': ('id', 'college_id')},
 'table_binding_orgs': {'bools': (), 'ints': ('id',)},
 'table_binding_prices': {'bools': (), 'ints': ('id', 'phase_id', 'product_id')},
 'table_binding_products': {'bools': (), 'ints': ('id', 'college_id', 'degree_id', 'service_id')},
 'table_binding_purchases': {'bools': (),
                             'ints': ('id',
                                      'college_id',
                                      'degree_id',
                                      'invoice_id',
                                      'product_id',
                                      'price_id')},
 'table_binding_rpl_exemption_requests': {'bools': (),
                                          'ints': ('id', 'degree_student_id', 'approved_credits')},
 'table_binding_st_students': {'bools': (), 'ints': ('id', 'student_id', 'workload_count', 'degree_count')},
 'table_binding_students': {'bools': (), 'ints': ('id', 'user_id', 'college_id')},
 'table_binding_subscription_phases': {'bools': (), 'ints': ('id', 'subscription_id')},
 'table_binding_subscriptions': {'bools': (), 'ints': ('id', 'college_id')},
 'tenant_kpis': {'bools': (),
                 'ints': ('college_id',
                          'new_enrol',
                          'enrol_change_m1',
                          'pauses',
                          'archives',
                          'net_additions',
                          'headline')},
 'tenant_month_report': {'bools': (),
                         'ints': ('college_id',
                                  'new_enrol',
                                  'pauses',
                                  'archives',
                                  'new_enrol_m1',
                                  'pauses_m1',
                                  'archives_m1',
                                  'new_enrol_m1_mtd',
                                  'new_enrol_y1',
                                  'new_enrol_y1_mtd',
                                  'active_base',
                                  'st_converted_this_month',
                                  'pba_count',
                                  'archived_30d',
                                  'st_till_last_month',
                                  'st_new_this_month',
                                  'rpl_low',
                                  'rpl_high',
                                  'featured_enrolments',
                                  'est_from_min_rev',
                                  'net_additions',
                                  'net_revsh')},
 'tenant_month_report_current': {'bools': (),
                                 'ints': ('college_id',
                                          'new_enrol',
                                          'pauses',
                                          'archives',
                                          'new_enrol_m1',
                                          'pauses_m1',
                                          'archives_m1',
                                          'new_enrol_m1_mtd',
                                          'new_enrol_y1',
                                          'new_enrol_y1_mtd',
                                          'active_base',
                                          'st_converted_this_month',
                                          'pba_count',
                                          'archived_30d',
                                          'st_till_last_month',
                                          'st_new_this_month',
                                          'rpl_low',
                                          'rpl_high',
                                          'featured_enrolments',
                                          'est_from_min_rev',
                                          'net_additions',
                                          'net_revsh')},
 'tenant_page': {'bools': (),
                 'ints': ('college_id',
                          'new_enrol',
                          'pauses',
                          'archives',
                          'new_enrol_m1',
                          'pauses_m1',
                          'archives_m1',
                          'new_enrol_m1_mtd',
                          'new_enrol_y1',
                          'new_enrol_y1_mtd',
                          'active_base',
                          'st_converted_this_month',
                          'pba_count',
                          'archived_30d',
                          'st_till_last_month',
                          'st_new_this_month',
                          'rpl_low',
                          'rpl_high',
                          'featured_enrolments',
                          'est_from_min_rev',
                          'net_additions',
                          'net_revsh')},
 'tenant_trend': {'bools': (), 'ints': ('college_id', 'new_enrol', 'pauses', 'archives')},
 'tenant_trend_net': {'bools': (), 'ints': ('college_id', 'new_enrol', 'pauses', 'archives', 'net')},
 'tenant_trend_rollup': {'bools': (), 'ints': ('college_id', 'new_enrol', 'pauses', 'archives')},
 'total_revenue': {'bools': (), 'ints': ('college_id',)},
 'verified_tenants': {'bools': (), 'ints': ('id',)},
 'workload_total': {'bools': (), 'ints': ('wlh_count',)}}
